"""Search queries. Vector queries are every fiftieth embedding, text queries the first three words of the benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallium.catalog import query
from recallium.functions import kernels as K
from recallium.functions import vector as V
from recallium.operators import search as S
from recallium.operators.stored import stored
from recallium.sources.memories import NOW, USAGE_SQL, VECTORS_SQL, base, scope_filter, table, usage, with_vectors

POOL, LIMIT, LEAST, HARD = 20, 10, 0.1, 0.35
_COS = "list_cosine_similarity(c.vector, q.vector)"
_QV = "qv AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS vector FROM embeddings WHERE vec_id % 50 = 0)"
_QT = "qt AS (SELECT item_id AS qid, array_to_string(string_split_regex(trim(text), '\\s+')[1:3], ' ') AS text FROM benchmark)"
_BM25 = f"""tok AS (SELECT doc_id, regexp_extract_all(lower(text), '{S.TOKEN}') AS t FROM documents), tot AS (SELECT count(*) AS n_docs, avg(len(t)) AS avg_len FROM tok),
 qtok AS (SELECT qid, unnest(list_distinct(regexp_extract_all(lower(text), '{S.TOKEN}'))) AS token FROM qt),
 tf AS (SELECT doc_id, len, token, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS token FROM tok) WHERE token IN (SELECT token FROM qtok) GROUP BY ALL),
 df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
 raw AS (SELECT qid, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * {S.K1 + 1} / (tf + {S.K1} * (1 - {S.B} + {S.B} * len / avg_len))), 9) AS bm25 FROM tf JOIN df USING (token) JOIN qtok USING (token), tot GROUP BY 1, 2),
 hits AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, doc_id) AS rank FROM raw QUALIFY rank <= {POOL}),
 norm AS (SELECT qid, doc_id, rank, greatest(0.0, (bm25 - min(bm25) OVER w) / coalesce(nullif(max(bm25) OVER w - min(bm25) OVER w, 0.0), 1.0)) AS b FROM hits WINDOW w AS (PARTITION BY qid))"""


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.slice(F.split(F.trim("text"), r"\s+"), 1, 3)
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.array_join(words, " ").alias("text"))


@query(f"""WITH {VECTORS_SQL}, {_QV}, r AS (SELECT qid, doc_id, round({_COS}, 12) AS cos, row_number() OVER (PARTITION BY qid ORDER BY round({_COS}, 12) DESC, doc_id) AS rank FROM vectors c, qv q)
 SELECT qid, doc_id, rank, round(1 / (1 + (1 - cos)), 6) AS score FROM r WHERE rank <= {POOL}""")
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine k-NN; the score is 1 / (1 + cosine distance)."""
    hits = V.knn(with_vectors(spark, sf_dir), vector_queries(spark, sf_dir), POOL)
    return hits.select("qid", "doc_id", "rank", F.round(1 / (2 - F.col("cos")), 6).alias("score"))


@query(f"WITH {_QT}, {_BM25} SELECT qid, doc_id, rank, round(b, 6) AS score FROM norm")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = S.min_max(S.bm25(base(spark, sf_dir), text_queries(spark, sf_dir), POOL))
    return hits.select("qid", "doc_id", "rank", F.round("bm25", 6).alias("score"))


@query(f"WITH {_QT}, {_BM25} SELECT qid, doc_id, round(CASE WHEN bm25 > 0 THEN 1 / (1 + exp(-bm25 / {K.MIDPOINT})) ELSE 0.5 END, 6) AS score FROM hits")
def bm25_sigmoid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = S.bm25(base(spark, sf_dir), text_queries(spark, sf_dir), POOL)
    return hits.select("qid", "doc_id", F.round(F.when(F.col("bm25") > 0, 1 / (1 + F.exp(-F.col("bm25") / K.MIDPOINT))).otherwise(0.5), 6).alias("score"))


_FUSED = f"""{VECTORS_SQL}, {_QT}, {_BM25}, nv AS (SELECT count(*) AS n FROM embeddings),
 q AS (SELECT qt.qid, e.embedding::DOUBLE[] AS vector FROM qt, nv JOIN embeddings e ON e.vec_id = (qt.qid * 7) % nv.n),
 vh AS (SELECT qid, doc_id, round({_COS}, 12) AS cos FROM vectors c, q QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round({_COS}, 12) DESC, doc_id) <= {POOL}),
 both_legs AS (SELECT qid, doc_id, 1 / (2 - vh.cos) AS v, norm.b FROM vh FULL JOIN norm USING (qid, doc_id)),
 fused AS (SELECT f.qid, f.doc_id, f.v, f.b, {K.FUSION} AS fused, CAST(length(d.text) AS DOUBLE) AS len FROM both_legs f JOIN documents d USING (doc_id)),
 scored AS (SELECT qid, doc_id, round({K.LENGTH.replace("s /", "fused /").replace("THEN s * 0.6 ELSE", "THEN fused * 0.6 ELSE")}, 9) AS score FROM fused WHERE fused >= {LEAST}),
 marked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank, max(score >= {HARD}) OVER (PARTITION BY qid) AS any_hit FROM scored)"""


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    n = vectors.agg(F.count(F.lit(1)).alias("n"))
    asked = text_queries(spark, sf_dir)
    paired = asked.select("qid").crossJoin(n).withColumn("vec_id", (F.col("qid") * 7) % F.col("n")).join(vectors, "vec_id").select("qid", "vector")
    vector_hits = V.knn(with_vectors(spark, sf_dir), paired, POOL).withColumn("v", 1 / (2 - F.col("cos")))
    text_hits = S.min_max(S.bm25(base(spark, sf_dir), asked, POOL)).withColumnRenamed("bm25", "b")
    lengths = base(spark, sf_dir).select("doc_id", F.length("text").cast("double").alias("len"))
    fused = S.fuse(vector_hits, text_hits).join(lengths, "doc_id").where(F.col("fused") >= LEAST)
    return fused.withColumn("s", F.col("fused")).withColumn("score", F.round(F.expr(K.LENGTH), 9))


@query(f"WITH {_FUSED} SELECT qid, doc_id, rank, round(score, 6) AS score, NOT any_hit AS is_fallback FROM marked WHERE (score >= {HARD} OR (NOT any_hit AND rank <= 3)) AND rank <= {LIMIT}")
def retrieve_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both legs, fusion, length normalisation, hard cutoff with fallback, top k; one plan for all queries."""
    kept = S.cutoff(_hybrid(spark, sf_dir), "score", HARD, 3)
    return S.top(kept, "score", LIMIT).select("qid", "doc_id", "rank", F.round("score", 6).alias("score"), "is_fallback")


@query()
def retrieve_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """retrieve_hybrid with near-equal vectors demoted; greedy, so without SQL."""
    hits = S.top(S.cutoff(_hybrid(spark, sf_dir), "score", HARD, 3), "score", LIMIT).drop("vector", "rank")
    return S.demote_similar(hits.join(with_vectors(spark, sf_dir).select("doc_id", "vector"), "doc_id"))


_LEX = "least(0.95, 0.72 + 0.02 * length(q.text))"


@query(f"""WITH {_QT}, m AS (SELECT q.qid, d.doc_id, greatest(CASE WHEN contains(lower(d.text), lower(q.text)) THEN {_LEX} ELSE 0 END, CASE WHEN contains(lower(d.text[1:60]), lower(q.text)) THEN {_LEX} * 0.98 ELSE 0 END) AS s
 FROM documents d, qt q WHERE contains(lower(d.text), lower(q.text))) SELECT qid, doc_id, round(CAST(s AS DOUBLE), 6) AS score FROM m QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, doc_id) <= {POOL}""")
def lexical_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring hits; used where the index is missing. The queries are broadcast in blocks, like those of k-NN."""
    asked = text_queries(spark, sf_dir).select("qid", F.lower("text").alias("q"))
    docs = base(spark, sf_dir).select("doc_id", F.lower("text").alias("t"))
    score = F.least(F.lit(0.95), 0.72 + 0.02 * F.length("q"))
    best = F.greatest(score, F.when(F.contains(F.substring("t", 1, 60), F.col("q")), score * 0.98).otherwise(0.0))
    hits = V.over_blocks(asked, lambda block: docs.join(F.broadcast(block), F.contains("t", "q")).select("qid", "doc_id", best.alias("score")))
    return S.top(hits, "score", POOL).select("qid", "doc_id", F.round("score", 6).alias("score"))


def _noise_bank(threshold: float, name: str) -> None:
    sql = f"WITH {VECTORS_SQL}, {_QV} SELECT c.doc_id, round(max({_COS}), 6) AS best, max({_COS}) >= {threshold} AS is_noise FROM vectors c, qv q GROUP BY 1"

    @query(sql, name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        near = V.best_of(with_vectors(spark, sf_dir), vector_queries(spark, sf_dir))
        return near.select("doc_id", F.round("cos", 6).alias("best"), (F.col("cos") >= threshold).alias("is_noise"))


#: Nearness to the closest noise prototype: the rule's own threshold, and a lower one that these vectors reach.
_noise_bank(0.82, "noise_bank")
_noise_bank(0.35, "noise_bank_wide")


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(coalesce(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0), 6) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    right = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")).join(right, "a").select("a", "b", F.round(V.cosine(F.col("x"), F.col("y")), 6).alias("cos"))


_PLANES = V.hyperplanes(16, 64)
_SIGN = " + ".join(f"CASE WHEN list_dot_product(embedding::DOUBLE[], {p}::DOUBLE[]) >= 0 THEN {1 << i} ELSE 0 END" for i, p in enumerate(_PLANES))


@query(f"SELECT vec_id, CAST({_SIGN} AS INTEGER) AS signature FROM embeddings")
def lsh_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", V.signature(F.col("embedding"), _PLANES).alias("signature"))


@query(
       f"WITH {VECTORS_SQL}, p AS (SELECT category, unnest(range(1, 65)) AS pos, unnest(vector) AS x FROM vectors) SELECT category, pos, round(avg(x), 6) AS mean FROM p GROUP BY 1, 2")
def mean_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_vectors(spark, sf_dir).select("category", F.posexplode("vector").alias("p", "x"))
    return rows.groupBy("category", (F.col("p") + 1).cast("long").alias("pos")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query(f"""WITH {VECTORS_SQL}, {_QV}, h AS (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.vector), 12) DESC, vec_id) AS rank FROM embeddings e, qv q QUALIFY rank <= 5),
 r AS (SELECT h.qid, h.rank, CAST(a.label = b.label AS INT) AS rel, t.n FROM h JOIN embeddings a ON a.vec_id = h.vec_id JOIN embeddings b ON b.vec_id = h.qid JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) t ON t.label = b.label)
 SELECT qid, round(sum(rel) / 5.0, 6) AS precision_at_5, round(sum(rel) / CAST(max(n) AS DOUBLE), 6) AS recall_at_5, round(coalesce(max(CASE WHEN rel = 1 THEN 1.0 / rank END), 0), 6) AS mrr,
 round(sum(rel / log2(rank + 1)) / 2.948459118879392, 6) AS ndcg_at_5 FROM r GROUP BY qid""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, reciprocal rank and NDCG at 5 with equal labels as relevance."""
    e = table(spark, sf_dir, "embeddings")
    hits = V.knn(e.select("vec_id", F.col("embedding").alias("vector")), vector_queries(spark, sf_dir), 5, "vec_id")
    sizes = e.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    asked = e.select(F.col("vec_id").alias("qid"), "label").join(sizes, "label").withColumnRenamed("label", "want")
    r = hits.join(e.select("vec_id", "label"), "vec_id").join(asked, "qid").withColumn("rel", (F.col("label") == F.col("want")).cast("int"))
    return r.groupBy("qid").agg(
        F.round(F.sum("rel") / 5.0, 6).alias("precision_at_5"), F.round(F.sum("rel") / F.max("n").cast("double"), 6).alias("recall_at_5"),
        F.round(F.coalesce(F.max(F.when(F.col("rel") == 1, 1.0 / F.col("rank"))), F.lit(0.0)), 6).alias("mrr"), F.round(F.sum(F.col("rel") / F.log2(F.col("rank") + 1)) / 2.948459118879392, 6).alias("ndcg_at_5"),
    )


@query(f"WITH {USAGE_SQL} SELECT doc_id FROM usage WHERE coalesce(scope, 'global') IN ('global', 'agent:src1')")
def scope_filter_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).where(scope_filter(["global", "agent:src1"])).select("doc_id")


@query("SELECT doc_id FROM documents WHERE false")
def scope_filter_deny_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).where(scope_filter([])).select("doc_id")


@query("SELECT doc_id FROM documents")
def scope_filter_bypass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).where(scope_filter(None)).select("doc_id")


@query(f"""WITH {USAGE_SQL}, q AS (SELECT DISTINCT doc_id % 50 AS qid FROM usage), r AS (SELECT doc_id % 50 AS qid, doc_id, s * (CASE WHEN doc_id % 50 < 10 THEN 0.3 ELSE 1 END) AS score FROM usage),
 m AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank, max(score >= 0.35) OVER (PARTITION BY qid) AS any_hit FROM r) SELECT qid, doc_id, NOT any_hit AS is_fallback FROM m WHERE score >= 0.35 OR (NOT any_hit AND rank <= 3)""")
def hard_cutoff_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usage(spark, sf_dir).select((F.col("doc_id") % 50).alias("qid"), "doc_id", (F.col("s") * F.when(F.col("doc_id") % 50 < 10, 0.3).otherwise(1.0)).alias("score"))
    return S.cutoff(rows, "score", 0.35, 3).select("qid", "doc_id", "is_fallback")


def _decision(near: float, name: str) -> None:
    """duplicate: an earlier memory of any category is nearer than 0.98; supersede: one of the same category, preference or entity, is
    nearer than `near`; else store."""
    sql = f"""WITH {VECTORS_SQL}, firsts AS (SELECT vec_id, category, min(doc_id) AS first FROM (SELECT *, doc_id % (SELECT count(*) FROM embeddings) AS vec_id FROM vectors) GROUP BY 1, 2),
 pairs AS (SELECT a.vec_id AS va, b.vec_id AS vb, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cos FROM embeddings a, embeddings b WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > {near}),
 d AS (SELECT b.doc_id, b.category, bool_or(p.cos > 0.98 AND f.first < b.doc_id) AS dup, bool_or(f.first < b.doc_id AND f.category = b.category) AS same FROM base b LEFT JOIN pairs p ON p.va = b.doc_id % (SELECT count(*) FROM embeddings) LEFT JOIN firsts f ON f.vec_id = p.vb GROUP BY 1, 2)
 SELECT doc_id, CASE WHEN coalesce(dup, false) THEN 'duplicate' WHEN coalesce(same, false) AND category IN ('preference', 'entity') THEN 'supersede' ELSE 'store' END AS decision FROM d"""

    @query(sql, name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = with_vectors(spark, sf_dir).select("doc_id", "category", "vector")
        different = stored(rows.groupBy("vector").agg(F.min("doc_id").alias("id")))  # a vector is known by its first memory
        rows = rows.join(different.withColumnRenamed("vector", "_vector"), F.col("vector").eqNullSafe(F.col("_vector")))
        firsts = rows.groupBy("id", "category").agg(F.min("doc_id").alias("first"))
        pairs = stored(V.near_pairs(different, near))
        both = pairs.select("a", "b", "cos").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos")).unionByName(different.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("cos")))
        old = both.join(firsts.select(F.col("id").alias("b"), F.col("category").alias("old_category"), "first"), "b")
        known = _earliest(old)
        joined = rows.select("doc_id", "category", "id").join(known, "id", "left")
        same = F.element_at("by", F.col("category"))
        return joined.select("doc_id", F.when(F.col("earliest") < F.col("doc_id"), "duplicate").when((same < F.col("doc_id")) & F.col("category").isin("preference", "entity"), "supersede").otherwise("store").alias("decision"))


def _earliest(old: DataFrame) -> DataFrame:
    """id, earliest (id of the first memory nearer than 0.98), by (category -> first memory near at all)."""
    per = old.groupBy(F.col("a").alias("id"), "old_category").agg(F.min("first").alias("first"), F.min(F.when(F.col("cos") > 0.98, F.col("first"))).alias("close"))
    return per.groupBy("id").agg(F.min("close").alias("earliest"), F.map_from_entries(F.collect_list(F.struct("old_category", "first"))).alias("by"))


_decision(0.95, "store_duplicate_decision")


@query(f"WITH {VECTORS_SQL}, {_QV}, n AS (SELECT q.qid, max({_COS}) AS m FROM vectors c, qv q WHERE c.vector <> q.vector AND c.ts <= {NOW} GROUP BY 1) SELECT qid, round(1 - greatest(0, m), 6) AS novelty FROM n")
def admission_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One minus the nearest cosine among other vectors."""
    near = V.nearest_other(with_vectors(spark, sf_dir).where(F.col("ts") <= NOW), vector_queries(spark, sf_dir))
    return near.select("qid", F.round(1 - F.greatest(F.lit(0.0), "cos"), 6).alias("novelty"))
