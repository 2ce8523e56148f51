"""Scores and lifecycle transitions over the usage table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallium.catalog import query
from recallium.functions import kernels as K
from recallium.functions import rules as R
from recallium.sources import memories as M
from recallium.sources.memories import DAY, NOW

#: The usage table with kind, the newer category.
USAGE_SQL = M.USAGE_SQL.rstrip().replace("usage AS (SELECT b.*,", f"usage AS (SELECT b.*, {R.LEGACY_CATEGORY_SQL} AS kind,")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.usage(spark, sf_dir).withColumn("kind", R.legacy_category(F.col("category"), F.col("text")))


#: name -> expression; each makes one query over all memories
SCORES = {
    "fuse_scores": K.FUSION, "rerank_blend": K.RERANK_BLEND, "rerank_unreturned": K.RERANK_UNRETURNED, "rerank_floor": K.rerank_floor(True), "rerank_lightweight": K.RERANK_LIGHT,
    "recency_boost": K.RECENCY, "importance_weight": K.IMPORTANCE, "length_normalization": K.LENGTH, "time_decay": K.TIME_DECAY, "effective_half_life": K.half_life("60.0"),
    "weibull_recency": K.WEIBULL, "access_frequency": K.FREQUENCY, "decay_composite": K.COMPOSITE, "decay_search_boost": K.SEARCH_BOOST, "consolidation_score": K.CONSOLIDATION,
    "confirmed_use": K.CONFIRM, "tier_age_weight": K.TIER_AGE, "confidence_update": K.CONFIDENCE_UPDATE, "reflection_score": K.REFLECTION, "derived_line_quality": K.LINE_QUALITY,
    "admission_score": K.ADMISSION, "intent_category_boost": K.INTENT_BOOST, "bm25_sigmoid_normalization": K.SIGMOID,
    "clamp_unit": K.clamp01("CASE WHEN doc_id % 9 = 0 THEN CAST('NaN' AS DOUBLE) WHEN doc_id % 9 = 1 THEN NULL ELSE s * 3.0 - 1.0 END", "0.25"),
}


def _register(name: str, text: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return usage(spark, sf_dir).select("doc_id", F.round(F.expr(text), 6).alias("value"))

    run.__doc__ = f"{name.replace('_', ' ')} of every memory."
    query(f"WITH {USAGE_SQL} SELECT doc_id, round({text}, 6) AS value FROM usage", name)(run)


for _name, _text in SCORES.items():
    _register(_name, _text)


@query(f"WITH {USAGE_SQL}, c AS (SELECT *, round({K.COMPOSITE}, 9) AS composite FROM usage) SELECT doc_id, tier, {K.TIER_NEXT} AS next_tier FROM c")
def tier_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = usage(spark, sf_dir).withColumn("composite", F.round(F.expr(K.COMPOSITE), 9))
    return scored.select("doc_id", "tier", F.expr(K.TIER_NEXT).alias("next_tier"))


@query(f"WITH {USAGE_SQL}, c AS (SELECT *, round({K.COMPOSITE}, 9) AS composite FROM usage) SELECT doc_id, round(composite, 6) AS composite FROM c WHERE composite < 0.3")
def stale_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = usage(spark, sf_dir).withColumn("composite", F.round(F.expr(K.COMPOSITE), 9))
    return scored.where("composite < 0.3").select("doc_id", F.round("composite", 6).alias("composite"))


_ACTED = f"""WITH {USAGE_SQL}, c AS (SELECT *, round({K.CONSOLIDATION}, 9) AS score FROM usage), a AS (SELECT *, {K.CONSOLIDATION_ACTION} AS action FROM c)"""
#: What is done about an action: a core memory is not promoted, and only memories of 30 days that are not archived yet are archived.
_CHANGE = f"""CASE WHEN action = 'promote' AND tier <> 'core' THEN 'promote-to-core' WHEN action = 'suppress' THEN 'suppress'
 WHEN action = 'archive' AND {NOW} - ts >= {30 * DAY} AND state <> 'archived' THEN 'archive' ELSE 'maintain' END"""
_NEXT_TIER = "CASE change WHEN 'promote-to-core' THEN 'core' WHEN 'archive' THEN 'peripheral' ELSE tier END"
_NEXT_STATE = "CASE change WHEN 'promote-to-core' THEN 'confirmed' WHEN 'suppress' THEN 'archived' WHEN 'archive' THEN 'archived' ELSE state END"


@query(f"{_ACTED}, d AS (SELECT *, {_CHANGE} AS change FROM a) SELECT doc_id, action, change, {_NEXT_TIER} AS next_tier, {_NEXT_STATE} AS next_state FROM d")
def consolidation_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usage(spark, sf_dir).withColumn("score", F.round(F.expr(K.CONSOLIDATION), 9)).withColumn("action", F.expr(K.CONSOLIDATION_ACTION))
    return rows.withColumn("change", F.expr(_CHANGE)).select("doc_id", "action", "change", F.expr(_NEXT_TIER).alias("next_tier"), F.expr(_NEXT_STATE).alias("next_state"))


#: A core memory counts as active unless it is archived or was recalled badly three times; no core memories: one half.
_HEALTH_SQL = """CASE WHEN count(*) = 0 THEN 0.5 ELSE 0.4 * coalesce(avg(CASE WHEN tier = 'core' THEN CASE WHEN state <> 'archived' AND bad_count < 3 THEN 1.0 ELSE 0.0 END END), 0.5)
 + 0.3 * avg(confidence) + 0.3 * (1.0 - sum(bad_count) / (sum(access_count) + 1.0)) END"""
STALE, UNHEALTHY, SURE = 0.2, 0.3, 0.6


def health(rows: DataFrame) -> DataFrame:
    """One row: health of a whole table with tier, state, confidence, bad_count and access_count."""
    active = F.avg(F.when(F.col("tier") == "core", ((F.col("state") != "archived") & (F.col("bad_count") < 3)).cast("double")))
    score = 0.4 * F.coalesce(active, F.lit(0.5)) + 0.3 * F.avg("confidence") + 0.3 * (1 - F.sum("bad_count") / (F.sum("access_count") + 1.0))
    return rows.agg(F.when(F.count(F.lit(1)) == 0, 0.5).otherwise(score).alias("health"))


@query(f"WITH {USAGE_SQL} SELECT round({_HEALTH_SQL}, 6) AS health FROM usage")
def memory_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health(usage(spark, sf_dir)).select(F.round("health", 6).alias("health"))


def recovered(rows: DataFrame, least: float = UNHEALTHY) -> DataFrame:
    """doc_id, state and tier of the archived memories that come back: those of at least SURE confidence, while health is below least."""
    low = health(rows).where(F.col("health") < least)  # one row or none
    back = rows.where((F.col("state") == "archived") & (F.col("confidence") >= SURE)).crossJoin(F.broadcast(low))
    return back.select("doc_id", F.lit("confirmed").alias("state"), F.when(F.col("tier") == "peripheral", "working").otherwise(F.col("tier")).alias("tier"))


def _sweep(least: float, name: str) -> None:
    @query(f"""WITH {USAGE_SQL}, h AS (SELECT {_HEALTH_SQL} AS health FROM usage)
 SELECT doc_id, 'confirmed' AS state, CASE tier WHEN 'peripheral' THEN 'working' ELSE tier END AS tier FROM usage, h WHERE state = 'archived' AND confidence >= {SURE} AND health < {least}""", name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return recovered(usage(spark, sf_dir), least)


#: At the rule's own limit, and at one that these tables fall below.
_sweep(UNHEALTHY, "sweep_recoverable")
_sweep(1.0, "sweep_recoverable_any")


@query(f"""WITH {USAGE_SQL}, c AS (SELECT *, round({K.COMPOSITE}, 9) AS composite FROM usage), t AS (SELECT count(*) AS memories, count(*) FILTER (composite < {STALE}) AS stale,
 {_HEALTH_SQL} AS health, count(*) FILTER (state = 'archived' AND confidence >= {SURE}) AS back FROM c)
 SELECT memories, stale, round(health, 6) AS health, CASE WHEN health < {UNHEALTHY} THEN back ELSE 0 END AS recovered FROM t""")
def sweep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over the whole table: memories, how many are stale, health, and how many come back."""
    rows = usage(spark, sf_dir).withColumn("composite", F.round(F.expr(K.COMPOSITE), 9))
    counts = rows.agg(F.count(F.lit(1)).alias("memories"), F.count_if(F.col("composite") < STALE).alias("stale"), F.count_if((F.col("state") == "archived") & (F.col("confidence") >= SURE)).alias("back"))
    out = counts.crossJoin(health(rows))  # one row each
    return out.select("memories", "stale", F.round("health", 6).alias("health"), F.when(F.col("health") < UNHEALTHY, F.col("back")).otherwise(0).alias("recovered"))


@query(f"WITH {USAGE_SQL} SELECT doc_id FROM usage WHERE ts <= {NOW} AND (invalidated_at IS NULL OR invalidated_at > {NOW})")
def active_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage(spark, sf_dir).where((F.col("ts") <= NOW) & (F.col("invalidated_at").isNull() | (F.col("invalidated_at") > NOW))).select("doc_id")


@query(f"WITH {USAGE_SQL} SELECT doc_id, valid_until FROM usage WHERE valid_until IS NOT NULL AND valid_until <= {NOW}")
def expired_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage(spark, sf_dir).where(F.col("valid_until") <= NOW).select("doc_id", "valid_until")


@query(f"WITH {USAGE_SQL} SELECT doc_id FROM usage WHERE state = 'confirmed' AND tier <> 'peripheral' AND bad_count < 5")
def recall_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Governance at recall: confirmed, in a recallable layer, not suppressed."""
    return usage(spark, sf_dir).where((F.col("state") == "confirmed") & (F.col("tier") != "peripheral") & (F.col("bad_count") < 5)).select("doc_id")


@query(f"WITH {USAGE_SQL} SELECT doc_id, CASE WHEN round({K.ADMISSION}, 9) < 0.45 THEN 'reject' WHEN round({K.ADMISSION}, 9) >= 0.6 AND coalesce(v, 0.0) < 0.55 THEN 'add' ELSE 'update_or_merge' END AS decision FROM usage")
def admission_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.round(F.expr(K.ADMISSION), 9)
    near = F.coalesce("v", F.lit(0.0))
    return usage(spark, sf_dir).select("doc_id", F.when(score < 0.45, "reject").when((score >= 0.6) & (near < 0.55), "add").otherwise("update_or_merge").alias("decision"))


@query(f"WITH {USAGE_SQL} SELECT doc_id FROM usage WHERE state = 'pending' AND ts < {NOW - 30 * DAY}")
def stale_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage(spark, sf_dir).where((F.col("state") == "pending") & (F.col("ts") < NOW - 30 * DAY)).select("doc_id")
