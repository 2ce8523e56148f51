"""Full-text and hybrid search as DataFrame plans over batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallium.functions import kernels
from recallium.operators.stored import stored

K1, B = 1.2, 0.75
#: Query tokens up to which they are broadcast.
MOST_TOKENS = 1 << 15
TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def postings(corpus: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """doc_id, len, token, tf for the tokens of vocabulary (token), and one row with the token '' for each row of corpus: one pass
    over the texts. A vocabulary of up to MOST_TOKENS, which is counted, is broadcast; a larger one is joined by a shuffle."""
    asked = vocabulary.select("token").where("token <> ''").distinct()
    few = asked.limit(MOST_TOKENS + 1).count() <= MOST_TOKENS
    asked = asked.unionByName(asked.sparkSession.range(1).select(F.lit("").alias("token")))
    split = corpus.select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    every = split.select("doc_id", F.size("tokens").alias("len"), F.explode(F.concat("tokens", F.array(F.lit("")))).alias("token"))
    return every.join(F.broadcast(asked) if few else asked, "token", "left_semi").groupBy("doc_id", "len", "token").agg(F.count(F.lit(1)).alias("tf"))


def bm25(corpus: DataFrame, queries: DataFrame, limit: int, among: DataFrame | None = None) -> DataFrame:
    """qid, doc_id, bm25 (raw), rank: the best `limit` rows a query, ties by id. corpus: doc_id, text; queries: qid, text.

    Texts are split once; lengths, totals and frequencies come from the postings of the queries' tokens, which are stored. They are dealt by
    row, so the hits of a row are added up where they are made. With among (doc_id) only its rows count, which postings are joined with,
    not texts."""
    asked = queries.select("qid", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    found = postings(corpus, asked)
    kept = stored(found if among is None else found.join(among.select("doc_id"), "doc_id", "left_semi"))
    total = kept.where("token = ''").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))
    tf = kept.where("token <> ''")
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    wanted = df.join(asked, "token")
    few = asked.limit(MOST_TOKENS + 1).count() <= MOST_TOKENS
    scored = tf.repartition("doc_id").join(F.broadcast(wanted) if few else wanted, "token").crossJoin(total)  # total is one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    sums = scored.groupBy("qid", "doc_id").agg(F.round(F.sum(part), 9).alias("bm25"))
    order = Window.partitionBy("qid").orderBy(F.desc("bm25"), "doc_id")
    return sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def min_max(hits: DataFrame, column: str = "bm25") -> DataFrame:
    """Per query over the fetched rows: the worst hit gets 0, as does a single one."""
    w = Window.partitionBy("qid")
    spread = F.max(column).over(w) - F.min(column).over(w)
    return hits.withColumn(column, F.greatest(F.lit(0.0), (F.col(column) - F.min(column).over(w)) / F.coalesce(F.nullif(spread, F.lit(0.0)), F.lit(1.0))))


def fuse(vector_hits: DataFrame, text_hits: DataFrame) -> DataFrame:
    """Full outer join of both legs (v and b), then the weighted score."""
    both = vector_hits.select("qid", "doc_id", "v").join(text_hits.select("qid", "doc_id", "b"), ["qid", "doc_id"], "full_outer")
    return both.withColumn("fused", F.expr(kernels.FUSION))


def cutoff(rows: DataFrame, score: str, least: float, keep: int) -> DataFrame:
    """Rows at or above least; a query that would lose all keeps its best ones, marked as fallback."""
    w = Window.partitionBy("qid")
    ranked = rows.withColumn("_rank", F.row_number().over(w.orderBy(F.desc(score), "doc_id"))).withColumn("_any", F.max(F.col(score) >= least).over(w))
    return ranked.where((F.col(score) >= least) | (~F.col("_any") & (F.col("_rank") <= keep))).withColumn("is_fallback", ~F.col("_any")).drop("_rank", "_any")


def top(rows: DataFrame, score: str, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc(score), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def demote_similar(rows: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Greedy diversity: a row too near to one already taken goes behind all others, in order. rows: qid, doc_id, score, vector; few a query."""

    def one(pdf):
        import numpy as np

        pdf = pdf.sort_values(["score", "doc_id"], ascending=[False, True], kind="stable")
        m = np.array([np.asarray(v, float) for v in pdf["vector"]])
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        taken, late = [], []
        for i in range(len(m)):
            (late if taken and (m[taken] @ m[i]).max() > threshold else taken).append(i)
        pdf = pdf.iloc[taken + late][["qid", "doc_id", "score"]].copy()
        pdf["rank"] = range(1, len(pdf) + 1)
        return pdf

    return rows.select("qid", "doc_id", "score", "vector").groupBy("qid").applyInPandas(one, "qid long, doc_id long, score double, rank int")
