"""Admission of candidate memories: five features against what is known in their scope, weighed by a preset, with the audit of the decision."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallium.functions import vector as V
from recallium.sources.memories import DAY

# Weights of the features, priors of the kinds, limits, memories looked at and half-life in days of the three presets; how near a match is.
FEATURES = ("utility", "confidence", "novelty", "recency", "typePrior")
PRIORS = {"profile": 0.95, "preferences": 0.9, "entities": 0.75, "events": 0.45, "cases": 0.8, "patterns": 0.85}
WEIGHTS = {"utility": 0.1, "confidence": 0.1, "novelty": 0.1, "recency": 0.1, "typePrior": 0.6}
MATCHED = 0.55


@dataclass(frozen=True)
class Preset:
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    priors: dict[str, float] = field(default_factory=lambda: dict(PRIORS))
    reject: float = 0.45
    admit: float = 0.6
    pool: int = 8
    half_life: float = 14.0

    def normalized(self) -> Preset:
        """Weights within 0 and 1 that are made to sum to 1; one that is missing or no number is the usual one, and if none is above 0 the usual ones
        hold. Limits and priors within 0 and 1, the lower limit not above the upper one."""
        kept = {f: min(1.0, max(0.0, w)) if math.isfinite(w := float(self.weights.get(f, math.nan))) else WEIGHTS[f] for f in FEATURES}
        total = sum(kept.values())
        weights = {f: w / total for f, w in kept.items()} if total > 0 else dict(WEIGHTS)
        unit = lambda x: min(1.0, max(0.0, float(x)))
        admit = unit(self.admit)
        return replace(self, weights=weights, reject=min(unit(self.reject), admit), admit=admit, priors={k: unit(self.priors.get(k, p)) for k, p in PRIORS.items()})


PRESETS = {
    "balanced": Preset(),
    "conservative": Preset({"utility": 0.16, "confidence": 0.16, "novelty": 0.18, "recency": 0.08, "typePrior": 0.42}, {"profile": 0.98, "preferences": 0.94, "entities": 0.78, "events": 0.28, "cases": 0.78, "patterns": 0.8}, 0.52, 0.68, 10, 10.0),
    "high-recall": Preset({"utility": 0.08, "confidence": 0.1, "novelty": 0.08, "recency": 0.14, "typePrior": 0.6}, {"profile": 0.96, "preferences": 0.92, "entities": 0.8, "events": 0.58, "cases": 0.84, "patterns": 0.88}, 0.34, 0.52, 6, 21.0),
}


def matches(candidates: DataFrame, memories: DataFrame, pool: int) -> DataFrame:
    """cid, compared, matched (ids, nearest first), max_similarity, latest: of the nearest memories of the scope those of the candidate's
    kind, or all where none is."""
    asked = candidates.where(F.size("vector") > 0).select(F.col("cid").alias("qid"), "vector", "scope")
    hits = V.knn(memories.select("id", "vector", "scope"), asked, pool, "id", "scope").join(memories.select("id", "kind", "ts"), "id")
    hits = hits.join(candidates.select(F.col("cid").alias("qid"), F.col("kind").alias("own")), "qid").withColumn("same", F.col("kind") == F.col("own"))
    whole = hits.groupBy("qid").agg(F.max("same").alias("some"), F.array_sort(F.collect_list(F.struct("rank", "id", "cos", "ts", "same"))).alias("all"))  # at most `pool`
    used = F.when(F.col("some"), F.filter("all", lambda x: x["same"])).otherwise(F.col("all"))
    return whole.select(F.col("qid").alias("cid"), used.alias("used")).select(
        "cid", F.transform("used", lambda x: x["id"]).alias("compared"), F.transform(F.filter("used", lambda x: x["cos"] >= MATCHED), lambda x: x["id"]).alias("matched"),
        F.greatest(F.lit(0.0), F.array_max(F.transform("used", lambda x: x["cos"]))).alias("max_similarity"), F.array_max(F.transform("used", lambda x: x["ts"])).alias("latest"),
    )


def _unit(x: Column, otherwise: float) -> Column:
    return F.when(x.isNull() | F.isnan(x), otherwise).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def evaluate(candidates: DataFrame, memories: DataFrame, preset: Preset, now: int) -> DataFrame:
    """cid, decision, hint, score, the five features, max_similarity, matched, compared, reason.

    candidates: cid, scope, kind, vector, utility (null where no model scored it: one half), confidence; memories: id, scope, kind, ts, vector.
    The recency of a candidate is the gap to the latest memory it is compared with, not its own age; without any it is new and recent."""
    p = preset.normalized()
    scoped = lambda df: df.withColumn("scope", F.coalesce("scope", F.lit("global")))
    known = matches(scoped(candidates), scoped(memories), p.pool)
    rows = candidates.join(known, "cid", "left")
    gap = F.greatest(F.lit(0), F.lit(now) - F.col("latest")) / DAY
    recency = F.when(F.col("latest").isNull() | (F.col("latest") <= 0) | F.lit(p.half_life <= 0), 1.0).otherwise(_unit(1 - F.pow(F.lit(2.0), -gap / p.half_life), 1.0))
    prior = F.lit(None).cast("double")
    for kind, value in p.priors.items():
        prior = F.when(F.col("kind") == kind, value).otherwise(prior)
    features = {"utility": _unit(F.col("utility"), 0.5), "confidence": _unit(F.col("confidence"), 0.0), "novelty": _unit(1 - F.coalesce("max_similarity", F.lit(0.0)), 1.0), "recency": recency, "typePrior": _unit(prior, 0.5)}
    rows = rows.select("cid", F.coalesce("max_similarity", F.lit(0.0)).alias("max_similarity"), "matched", "compared", *(c.alias(n) for n, c in features.items()))
    rows = rows.withColumn("score", F.round(sum((F.col(f) * w for f, w in p.weights.items()), F.lit(0.0)), 9))
    decision = F.when(F.col("score") < p.reject, "reject").otherwise("pass_to_dedup")
    hint = F.when(F.col("score") < p.reject, None).when((F.col("score") >= p.admit) & (F.col("max_similarity") < MATCHED), "add").otherwise("update_or_merge")
    three = lambda c: F.format_string("%.3f", c)
    reason = F.when(F.col("score") < p.reject, F.concat(F.lit("Admission rejected ("), three(F.col("score")), F.lit(f" < {p.reject:.3f}). maxSimilarity="), three(F.col("max_similarity")), F.lit(".")))
    reason = reason.otherwise(F.concat(F.lit("Admission passed ("), three(F.col("score")), F.lit("); hint="), hint, F.lit("; maxSimilarity="), three(F.col("max_similarity")), F.lit(".")))
    return rows.select("cid", decision.alias("decision"), hint.alias("hint"), "score", *FEATURES, "max_similarity", "matched", "compared", reason.alias("reason"))
