"""Admission of the benchmark items as candidates against the memories of their scope, under each preset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallium.catalog import query
from recallium.operators import admission as A
from recallium.plans import dedup_queries as D
from recallium.sources.memories import NOW, VECTORS_SQL, with_vectors

_UTILITY = "CASE WHEN item_id % 4 = 0 THEN NULL ELSE (item_id * 31 % 100) / 100.0 END"
_CONFIDENCE = "(item_id * 17 % 100) / 100.0"


def _sql(name: str) -> str:
    p = A.PRESETS[name].normalized()
    prior = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in p.priors.items()) + " END"
    score = " + ".join(f"{f} * {w!r}" for f, w in zip(("utility", "confidence", "novelty", "recency", "prior"), p.weights.values(), strict=True))
    return f"""SELECT * FROM (WITH h AS (SELECT c.cid, c.kind, m.kind = c.kind AS same, m.ts, round(list_cosine_similarity(c.vector, m.vector), 12) AS cos, m.id FROM c JOIN m ON m.scope = c.scope QUALIFY row_number() OVER (PARTITION BY c.cid ORDER BY cos DESC, m.id) <= {p.pool}),
 u AS (SELECT * FROM h QUALIFY same OR NOT bool_or(same) OVER (PARTITION BY cid)), k AS (SELECT cid, greatest(0.0, max(cos)) AS sim, max(ts) AS latest, count(*) FILTER (cos >= 0.55) AS matched, count(*) AS compared FROM u GROUP BY cid),
 f AS (SELECT cid, coalesce(sim, 0) AS sim, coalesce(matched, 0) AS matched, coalesce(compared, 0) AS compared, coalesce(utility, 0.5) AS utility, confidence, 1 - coalesce(sim, 0) AS novelty, CASE WHEN latest IS NULL THEN 1.0 ELSE 1 - power(2.0, -(greatest(0, {NOW} - latest) / 86400000.0) / {p.half_life}) END AS recency, {prior} AS prior FROM c LEFT JOIN k USING (cid)),
 s AS (SELECT *, round({score}, 9) AS score FROM f)
 SELECT '{name}' AS preset, cid, CASE WHEN score < {p.reject} THEN 'reject' ELSE 'pass_to_dedup' END AS decision, CASE WHEN score < {p.reject} THEN NULL WHEN score >= {p.admit} AND sim < 0.55 THEN 'add' ELSE 'update_or_merge' END AS hint, round(score, 6) AS score, matched, compared FROM s)"""


@query(f"""WITH {VECTORS_SQL}, m AS (SELECT doc_id AS id, coalesce(scope, 'global') AS scope, {D._KIND.format('doc_id')} AS kind, ts, vector FROM vectors),
 c AS (SELECT -1 - item_id AS cid, {D._SCOPE} AS scope, {D._KIND.format('item_id')} AS kind, e.embedding::DOUBLE[] AS vector, {_UTILITY} AS utility, {_CONFIDENCE} AS confidence FROM benchmark JOIN embeddings e ON e.vec_id = (item_id * 7) % (SELECT count(*) FROM embeddings))
 {' UNION ALL '.join(_sql(n) for n in A.PRESETS)}""")
def admission_by_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision, hint and score of each candidate under the three presets. Utility and confidence are made from the id; a model and
    confidence_support give them otherwise."""
    memories = with_vectors(spark, sf_dir).select(F.col("doc_id").alias("id"), "scope", F.expr(D._KIND.format("doc_id")).alias("kind"), "ts", "vector")
    item = -1 - F.col("cid")
    asked = D.candidates(spark, sf_dir).withColumn("item_id", item).select("cid", "scope", F.col("category").alias("kind"), "vector", F.expr(_UTILITY).cast("double").alias("utility"), F.expr(_CONFIDENCE).cast("double").alias("confidence"))
    out = None
    for name, preset in A.PRESETS.items():
        part = A.evaluate(asked, memories, preset, NOW).select(F.lit(name).alias("preset"), "cid", "decision", "hint", F.round("score", 6).alias("score"), F.size(F.coalesce("matched", F.array())).cast("long").alias("matched"), F.size(F.coalesce("compared", F.array())).cast("long").alias("compared"))
        out = part if out is None else out.unionByName(part)
    return out
