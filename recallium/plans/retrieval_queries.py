"""The whole read path for all text queries: without decay, with it, and in one scope and category."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallium.catalog import query
from recallium.functions import kernels as K
from recallium.functions import patterns as P
from recallium.operators.retrieval import Options, retrieve
from recallium.plans import lifecycle_queries as L
from recallium.plans.search_queries import _BM25, _QT, POOL, text_queries
from recallium.sources.memories import NOW, table


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    n = vectors.agg(F.count(F.lit(1)).alias("n"))
    return L.usage(spark, sf_dir).crossJoin(n).withColumn("vec_id", F.col("doc_id") % F.col("n")).join(vectors, "vec_id").drop("n", "vec_id")  # n is one row


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.length("text").cast("double").alias("len"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    n = vectors.agg(F.count(F.lit(1)).alias("n"))
    return text_queries(spark, sf_dir).crossJoin(n).withColumn("vec_id", (F.col("qid") * 7) % F.col("n")).join(vectors, "vec_id").select("qid", "text", "vector")  # n is one row


def path_sql(o: Options) -> str:
    """The stages one behind the other; diversity is a recursive walk down the ranks of a query."""
    clamp = lambda x, other: f"CASE WHEN ({x}) IS NULL OR isnan({x}) THEN {other} ELSE least(1.0, greatest(0.0, {x})) END"
    days = f"greatest(0.0, CAST({NOW} - CASE WHEN ts > 0 THEN ts ELSE {NOW} END AS DOUBLE) / 86400000.0)"
    stages = [("s1", clamp("0.7 * s0 + 0.3 * cos", "s0"))]
    if not o.decay:
        stages += [("s2", clamp(f"s1 + exp(-{days} / 14.0) * 0.1", "s1")), ("s3", clamp("s2 * (0.85 + 0.15 * coalesce(importance, 0.7))", "s2 * 0.85"))]
    at = stages[-1][0]
    length = f"s{int(at[1:]) + 1}"
    stages.append((length, clamp(f"{at} / (1 + 0.5 * log2(greatest(len / 500.0, 1.0)))", f"{at} * 0.6")))
    last = f"s{int(at[1:]) + 2}"
    order = lambda s: ", ".join([*(f"{n} DESC" for n in reversed(s)), "v_rank NULLS LAST", "b_rank NULLS LAST", "doc_id"])
    names = ["s0", *(n for n, _ in stages)]
    chain, before = [], "x1"
    for i, (n, text) in enumerate(stages):
        chain.append(f"y{i} AS (SELECT *, round({text}, 9) AS {n} FROM {before})")
        before = f"y{i}"
    in_scope = f"AND coalesce(scope, 'global') IN ({', '.join(repr(s) for s in o.scopes)})" if o.scopes is not None else ""
    of_kind = f"WHERE category = '{o.category}'" if o.category else ""
    bm25 = _BM25.replace("FROM documents)", "FROM there)")
    final = K.SEARCH_BOOST if o.decay else K.TIME_DECAY
    return f"""WITH RECURSIVE {L.USAGE_SQL}, vecs AS (SELECT doc_id, e.embedding::DOUBLE[] AS vector FROM base JOIN embeddings e ON e.vec_id = doc_id % (SELECT count(*) FROM embeddings)),
 there AS (SELECT u.*, w.vector FROM usage u JOIN vecs w USING (doc_id) WHERE ts <= {NOW} AND (invalidated_at IS NULL OR invalidated_at > {NOW}) {in_scope}), {_QT}, {bm25},
 q AS (SELECT qt.qid, e.embedding::DOUBLE[] AS qvec FROM qt JOIN embeddings e ON e.vec_id = (qt.qid * 7) % (SELECT count(*) FROM embeddings)),
 vh AS (SELECT qid, doc_id, 1 / (2 - round(list_cosine_similarity(vector, qvec), 12)) AS v, row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(vector, qvec), 12) DESC, doc_id) AS v_rank FROM there, q QUALIFY v_rank <= {POOL}),
 h AS (SELECT qid, doc_id, vh.v, v_rank, norm.b, norm.rank AS b_rank FROM (SELECT * FROM vh WHERE v >= 0.1) vh FULL JOIN norm USING (qid, doc_id)),
 x0 AS (SELECT t.* EXCLUDE (v, b, s), h.qid, h.v, h.b, v_rank, b_rank, CASE WHEN h.v IS NOT NULL THEN 2 - 1 / h.v ELSE coalesce(list_cosine_similarity(vector, qvec), 0) END AS cos FROM h JOIN there t USING (doc_id) JOIN q USING (qid) {of_kind}),
 f AS (SELECT *, round({K.FUSION}, 9) AS s0 FROM x0 WHERE valid_until IS NULL OR valid_until > {NOW}),
 x1 AS (SELECT * FROM f WHERE s0 >= {o.least} QUALIFY row_number() OVER (PARTITION BY qid ORDER BY {order(['s0'])}) <= {2 * o.limit}), {', '.join(chain)},
 cut AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {order(names)}) AS place, NOT max({length} >= {o.hard_least}) OVER (PARTITION BY qid) AS is_fallback FROM {before}),
 z AS (SELECT *, round({final}, 9) AS {last} FROM (SELECT *, {length} AS s FROM cut WHERE {length} >= {o.hard_least} OR (is_fallback AND place <= 3))),
 d AS (SELECT qid, doc_id, vector, is_fallback, {last} AS score, row_number() OVER (PARTITION BY qid ORDER BY {order([*names, last])}) AS n FROM (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM z) WHERE NOT (length(t) < 5 OR {P.any_sql('t', P.DENIAL + P.META_QUESTION + P.BOILERPLATE + P.DIAGNOSTIC + P.PLATFORM)})),
 w AS (SELECT qid, CAST(0 AS BIGINT) AS n, CAST([] AS DOUBLE[][]) AS taken, CAST(NULL AS BIGINT) AS doc_id, false AS late FROM (SELECT DISTINCT qid FROM d) UNION ALL
  SELECT qid, n, CASE WHEN late THEN taken ELSE list_append(taken, vector) END, doc_id, late FROM (SELECT w.qid, d.n, w.taken, d.vector, d.doc_id, len(list_filter(w.taken, lambda t: list_cosine_similarity(t, d.vector) > 0.85)) > 0 AS late FROM w JOIN d ON d.qid = w.qid AND d.n = w.n + 1))
SELECT qid, doc_id, rank, round(score, 6) AS score, is_fallback FROM (SELECT d.*, row_number() OVER (PARTITION BY d.qid ORDER BY late, d.n) AS rank FROM d JOIN w ON w.qid = d.qid AND w.doc_id = d.doc_id) WHERE rank <= {o.limit}"""


PLAIN, DECAYED, NARROW = Options(), Options(decay=True, limit=8), Options(scopes=("global", "agent:src1"), category="fact", limit=6)


@query(path_sql(PLAIN))
def retrieve_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recency, importance and time decay."""
    return retrieve(memories(spark, sf_dir), asked(spark, sf_dir), PLAIN, texts=texts(spark, sf_dir))


@query(path_sql(DECAYED))
def retrieve_path_with_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decay engine's boost in place of recency, importance and time decay."""
    return retrieve(memories(spark, sf_dir), asked(spark, sf_dir), DECAYED, texts=texts(spark, sf_dir))


@query(path_sql(NARROW))
def retrieve_path_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scopes and one category."""
    return retrieve(memories(spark, sf_dir), asked(spark, sf_dir), NARROW, texts=texts(spark, sf_dir))
