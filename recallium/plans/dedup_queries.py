"""New memories deduplicated against the table, from candidates to the resulting rows."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallium.catalog import query
from recallium.operators import deduplication as D
from recallium.plans.rule_queries import _like_sql
from recallium.sources.memories import VECTORS_SQL, table, with_vectors

# Candidates are the benchmark items, ten a batch, in three scopes; their answers are made from the id.
_KIND = "CASE {0} % 6 WHEN 0 THEN 'preferences' WHEN 1 THEN 'entities' WHEN 2 THEN 'profile' WHEN 3 THEN 'patterns' WHEN 4 THEN 'events' ELSE 'cases' END"
_SCOPE = "CASE item_id % 3 WHEN 0 THEN 'global' WHEN 1 THEN 'agent:src1' ELSE 'agent:src2' END"
_SAID = "CASE item_id % 8 WHEN 0 THEN 'Merge' WHEN 1 THEN 'supersede' WHEN 2 THEN 'contradict' WHEN 3 THEN 'skip' WHEN 4 THEN 'odd' WHEN 5 THEN 'support' WHEN 6 THEN 'SUPERSEDE' ELSE 'contextualize' END"
_PLACE = "CASE item_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 4 ELSE item_id % 3 + 1 END"
_LABEL = "CASE WHEN item_id % 4 < 2 THEN 'general' ELSE 'travel' END"
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_vectors(spark, sf_dir)
    none = F.array().cast("array<struct<type: string, targetId: string>>")
    return rows.select(
        F.col("doc_id").alias("id"), F.coalesce("scope", F.lit("global")).alias("scope"), F.expr(_KIND.format("doc_id")).alias("category"), "text", F.col("vector").cast("array<double>").alias("vector"),
        (F.col("doc_id") % 4 != 3).alias("active"), none.alias("relations"), F.lit(0).cast("long").alias("supports"), F.lit(0).cast("long").alias("contradictions"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    n = vectors.agg(F.count(F.lit(1)).alias("n"))
    items = table(spark, sf_dir, "benchmark").crossJoin(n).withColumn("vec_id", (F.col("item_id") * 7) % F.col("n")).join(vectors, "vec_id")  # n is one row
    return items.select(
        (-1 - F.col("item_id")).alias("cid"), F.expr(_SCOPE).alias("scope"), F.floor(F.col("item_id") / 10).alias("batch"), F.col("item_id").alias("position"), F.expr(_KIND.format("item_id")).alias("category"), "text", "vector",
        F.expr(_SAID).alias("said"), F.expr(_PLACE).cast("long").alias("place"), F.expr(_LABEL).alias("label"),
    )


def answer(row, shown: list) -> tuple:
    """The stand-in for a model: the answer that lies with the candidate."""
    return row.said, None if row.place is None or row.place != row.place else int(row.place), row.label


@cache
def _sql() -> str:
    """The fold as a recursive query: one step takes the next candidate of every scope; lists of ids are the state."""
    described = "{{'ord': -{0}, 'id': {1}, 'own': {2}, 'kind': {3}, 'brand': {4}, 'item': {5}}}"
    cos = "round(list_cosine_similarity(c.vector, m.vector), 12)"
    score = f"1 / (2 - {cos})"
    slots = lambda t, key: f"{t}_n AS (SELECT {key}, trim(regexp_replace(regexp_replace(text, '(?m)^\\[(用户|助手)\\]\\s*', '', 'g'), '\\s+', ' ', 'g')) AS n FROM {t}_raw), {t}_e AS (SELECT {key}, {_like_sql(0)}, {_like_sql(1)} FROM {t}_n), {t}_l AS (SELECT {key}, CASE WHEN brand0 <> '' AND len(items0) > 0 THEN brand0 ELSE brand1 END AS b, CASE WHEN brand0 <> '' AND len(items0) > 0 THEN items0 ELSE items1 END AS i FROM {t}_e), {t} AS (SELECT r.*, CASE WHEN b <> '' AND len(i) = 1 THEN b END AS brand, CASE WHEN b <> '' AND len(i) = 1 THEN i[1] END AS item FROM {t}_raw r JOIN {t}_l USING ({key}))"
    entry = lambda own, key: described.format(score, f"m.{key}", own, "m.category", "m.brand", "m.item")
    return f"""WITH RECURSIVE {VECTORS_SQL}, mem_raw AS (SELECT doc_id AS id, coalesce(scope, 'global') AS scope, {_KIND.format('doc_id')} AS category, text, vector, doc_id % 4 <> 3 AS active FROM vectors),
 cand_raw AS (SELECT -1 - item_id AS cid, {_SCOPE} AS scope, item_id // 10 AS batch, item_id AS position, {_KIND.format('item_id')} AS category, text, e.embedding::DOUBLE[] AS vector, {_SAID} AS said, {_PLACE} AS place, {_LABEL} AS label, row_number() OVER (PARTITION BY {_SCOPE} ORDER BY item_id) AS n FROM benchmark JOIN embeddings e ON e.vec_id = (item_id * 7) % (SELECT count(*) FROM embeddings)),
 {slots('mem', 'id')}, {slots('cand', 'cid')},
 pairs AS (SELECT c.cid, {score} AS score, m.active AS near, {entry('false', 'id')} AS x FROM cand c JOIN mem m ON m.scope = c.scope UNION ALL SELECT c.cid, {score}, true, {entry('true', 'cid')} FROM cand c JOIN cand m ON m.scope = c.scope AND m.cid <> c.cid),
 lists AS (SELECT cid, list(x ORDER BY x.ord, x.id) FILTER (near AND score >= {D.NEAR}) AS near, list(x ORDER BY x.ord, x.id) FILTER (score >= {D.PROFILE_NEAR}) AS around FROM pairs GROUP BY cid),
 cl AS MATERIALIZED (SELECT c.* EXCLUDE (vector), coalesce(near, []) AS near, coalesce(around, []) AS around FROM cand c LEFT JOIN lists USING (cid)),
 walk AS (SELECT scope, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS batch, CAST([] AS BIGINT[]) AS gone, CAST([] AS BIGINT[]) AS made, CAST([] AS BIGINT[]) AS pending, CAST(NULL AS BIGINT) AS cid, CAST(NULL AS VARCHAR) AS decision, CAST(NULL AS BIGINT) AS match FROM (SELECT DISTINCT scope FROM cl) UNION ALL
  SELECT scope, n, batch, CASE WHEN decision = 'supersede' THEN list_append(gone, match) ELSE gone END, CASE WHEN decision = 'supersede' THEN list_append(made, cid) ELSE made END, CASE WHEN decision IN ('create', 'contextualize', 'contradict') THEN list_append(pending, cid) ELSE pending END, cid, decision, match FROM (
   SELECT *, CASE WHEN decision IN ('merge', 'support', 'contextualize', 'contradict', 'supersede') THEN target END AS match FROM (
    SELECT *, CASE WHEN category = 'profile' THEN CASE WHEN best.kind = 'profile' THEN 'merge' ELSE 'create' END WHEN len(looked) = 0 THEN 'create'
     WHEN category = 'preferences' AND brand IS NOT NULL AND len(list_filter(looked, lambda x: coalesce(x.brand = brand AND x.item <> item, false))) = len(looked) THEN 'create' WHEN act NOT IN {_IN(D.DECISIONS)} OR (said IN {_IN(D.ENDING)} AND NOT named) THEN 'create'
     WHEN (act = 'merge' AND category NOT IN {_IN(D.MERGEABLE)}) OR (act = 'supersede' AND category NOT IN {_IN(D.VERSIONED)}) THEN 'create' ELSE act END AS decision, CASE WHEN category = 'profile' THEN best.id WHEN named THEN looked[place].id ELSE looked[1].id END AS target FROM (
     SELECT *, CASE WHEN said = 'contradict' AND named AND category IN {_IN(D.VERSIONED)} AND label = 'general' THEN 'supersede' ELSE said END AS act FROM (
      SELECT *, coalesce(place BETWEEN 1 AND least({D.SHOWN}, len(looked)), false) AS named FROM (
       SELECT w.scope, c.n, c.batch, c.cid, c.category, lower(c.said) AS said, c.place, c.label, c.brand, c.item, w.gone, CASE WHEN c.batch <> w.batch THEN w.made || w.pending ELSE w.made END AS made, CASE WHEN c.batch <> w.batch THEN CAST([] AS BIGINT[]) ELSE w.pending END AS pending,
        list_filter(c.near, lambda x: (NOT x.own OR list_contains(CASE WHEN c.batch <> w.batch THEN w.made || w.pending ELSE w.made END, x.id)) AND NOT list_contains(w.gone, x.id))[1:{D.LOOKED_AT}] AS looked, list_filter(c.around, lambda x: NOT x.own OR list_contains(CASE WHEN c.batch <> w.batch THEN w.made || w.pending ELSE w.made END, x.id))[1] AS best
       FROM walk w JOIN cl c ON c.scope = w.scope AND c.n = w.n + 1)))))),
 done AS (SELECT cid, decision, match FROM walk WHERE cid IS NOT NULL)"""


@query(f"{_sql()} SELECT cid, decision, match FROM done")
def dedup_batch_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is decided about each candidate, in order, each seeing what the earlier ones did."""
    return D.deduplicate(memories(spark, sf_dir), candidates(spark, sf_dir), answer)[1].select("cid", "decision", "match")


@query(f"""{_sql()}, alln AS (SELECT id, category, active, text, '' AS edges FROM mem UNION ALL SELECT c.cid, c.category, true, c.text, CASE decision WHEN 'supersede' THEN 'supersedes:' || match WHEN 'contextualize' THEN 'contextualizes:' || match WHEN 'contradict' THEN 'contradicts:' || match ELSE '' END FROM cand c JOIN done USING (cid) WHERE decision IN ('create', 'supersede', 'contextualize', 'contradict')),
 eff AS (SELECT match AS id, max(d.cid) FILTER (decision = 'supersede') AS ended, count(*) FILTER (decision IN ('support', 'merge')) AS supports, count(*) FILTER (decision = 'contradict') AS contradictions, arg_max(c.text, c.position) FILTER (decision = 'merge') AS new_text FROM done d JOIN cand c ON c.cid = d.cid WHERE match IS NOT NULL GROUP BY 1)
 SELECT id, category, active AND ended IS NULL AS active, md5(coalesce(new_text, text, '')) AS text_md5, CASE WHEN ended IS NULL THEN edges WHEN edges = '' THEN 'superseded_by:' || ended ELSE edges || ' superseded_by:' || ended END AS edges, coalesce(supports, 0) AS supports, coalesce(contradictions, 0) AS contradictions FROM alln LEFT JOIN eff USING (id)""")
def deduplicated_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memories after a run of candidates: new rows, edges of both ends, merged texts, counts."""
    rows, _ = D.deduplicate(memories(spark, sf_dir), candidates(spark, sf_dir), answer)
    edges = F.array_join(F.transform("relations", lambda r: F.concat(r["type"], F.lit(":"), r["targetId"])), " ")
    return rows.select("id", "category", "active", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), edges.alias("edges"), "supports", "contradictions")
