"""The memories table, laid over documents, embeddings and events; reads, filters and updates on it.

Times are epoch milliseconds; NOW is a fixed clock just after the last event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = 1706659200000
DAY = 86400000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(value: Column, *options) -> Column:
    """options[value] as a literal chain."""
    out = F.when(value == 0, F.lit(options[0]))
    for i, o in enumerate(options[1:], 1):
        out = out.when(value == i, F.lit(o))
    return out


def millis(column: str) -> Column:
    """Epoch milliseconds of a timestamp without time zone, whatever the session's zone; parts of a millisecond are cut off downwards."""
    micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))")
    return F.floor((micros - F.pmod(micros, F.lit(1000))) / 1000).cast("long")


MILLIS_SQL = "((epoch_us(ts) - ((epoch_us(ts) % 1000) + 1000) % 1000) // 1000)"


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without vectors and usage."""
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("doc_id").cast("string").alias("id"), "text", "source",
        pick(i % 5, "preference", "fact", "decision", "entity", "other").alias("category"),
        F.when(i % 7 == 0, None).when(i % 3 == 0, "global").otherwise(F.concat(F.lit("agent:"), "source")).alias("scope"),
        ((i % 10).cast("double") / 10).alias("importance"), (F.lit(NOW) - (i % 120) * DAY).alias("ts"),
    )


BASE_SQL = f"""base AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, text, source,
 CASE doc_id % 5 WHEN 0 THEN 'preference' WHEN 1 THEN 'fact' WHEN 2 THEN 'decision' WHEN 3 THEN 'entity' ELSE 'other' END AS category,
 CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'global' ELSE 'agent:' || source END AS scope,
 CAST(doc_id % 10 AS DOUBLE) / 10 AS importance, CAST({NOW} - (doc_id % 120) * {DAY} AS BIGINT) AS ts FROM documents)"""


def with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    n = vectors.agg(F.count(F.lit(1)).alias("n"))
    rows = base(spark, sf_dir).crossJoin(n).withColumn("vec_id", F.col("doc_id") % F.col("n")).drop("n")  # n is one row
    return rows.join(vectors.select("vec_id", F.col("embedding").alias("vector")), "vec_id")


VECTORS_SQL = BASE_SQL + """, vectors AS (SELECT b.*, e.embedding::DOUBLE[] AS vector FROM base b JOIN embeddings e ON e.vec_id = b.doc_id % (SELECT count(*) FROM embeddings))"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With counts and last times of accesses, injections, confirmed uses and bad recalls, from one aggregation of events."""
    events = table(spark, sf_dir, "events")
    docs = base(spark, sf_dir)
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    ms = millis("ts")
    on = lambda kind: F.col("event_type") == kind
    used = events.crossJoin(n).groupBy((F.col("user_id") % F.col("n")).alias("doc_id")).agg(
        F.count_if(on("view")).alias("access_count"), F.max(F.when(on("view"), ms)).alias("last_accessed_at"),
        F.count_if(on("click")).alias("injected_count"), F.max(F.when(on("click"), ms)).alias("last_injected_at"),
        F.max(F.when(on("purchase"), ms)).alias("last_confirmed_at"), F.count_if(on("error")).alias("bad_count"),
    )
    i = F.col("doc_id")
    rows = docs.join(used, "doc_id", "left").fillna(0, ["access_count", "injected_count", "bad_count"])
    return rows.select(
        "*", ((i % 8).cast("double") / 10 + 0.3).alias("confidence"), pick(i % 3, "core", "working", "peripheral").alias("tier"),
        pick(i % 4, "confirmed", "pending", "confirmed", "archived").alias("state"), (i % 4 == 0).alias("dynamic"),
        F.when(i % 11 == 0, F.col("ts") + 5 * DAY).alias("invalidated_at"), F.when(i % 13 == 0, F.col("ts") + 40 * DAY).alias("valid_until"),
        ((i * 37 % 100).cast("double") / 100).alias("s"), F.when(i % 6 != 0, (i * 13 % 100).cast("double") / 100).alias("v"),
        F.when(i % 5 != 0, (i * 29 % 101).cast("double") / 100).alias("b"), F.length("text").cast("double").alias("len"),
    )


USAGE_SQL = BASE_SQL + f""", used AS (SELECT user_id % (SELECT count(*) FROM documents) AS doc_id,
 count(*) FILTER (event_type = 'view') AS access_count, max({MILLIS_SQL}) FILTER (event_type = 'view') AS last_accessed_at,
 count(*) FILTER (event_type = 'click') AS injected_count, max({MILLIS_SQL}) FILTER (event_type = 'click') AS last_injected_at,
 max({MILLIS_SQL}) FILTER (event_type = 'purchase') AS last_confirmed_at, count(*) FILTER (event_type = 'error') AS bad_count FROM events GROUP BY 1),
usage AS (SELECT b.*, coalesce(u.access_count, 0) AS access_count, u.last_accessed_at, coalesce(u.injected_count, 0) AS injected_count, u.last_injected_at,
 u.last_confirmed_at, coalesce(u.bad_count, 0) AS bad_count, CAST(b.doc_id % 8 AS DOUBLE) / 10 + 0.3 AS confidence,
 CASE b.doc_id % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'working' ELSE 'peripheral' END AS tier,
 CASE b.doc_id % 4 WHEN 1 THEN 'pending' WHEN 3 THEN 'archived' ELSE 'confirmed' END AS state, b.doc_id % 4 = 0 AS dynamic,
 CASE WHEN b.doc_id % 11 = 0 THEN b.ts + {5 * DAY} END AS invalidated_at, CASE WHEN b.doc_id % 13 = 0 THEN b.ts + {40 * DAY} END AS valid_until,
 CAST(b.doc_id * 37 % 100 AS DOUBLE) / 100 AS s, CASE WHEN b.doc_id % 6 <> 0 THEN CAST(b.doc_id * 13 % 100 AS DOUBLE) / 100 END AS v,
 CASE WHEN b.doc_id % 5 <> 0 THEN CAST(b.doc_id * 29 % 101 AS DOUBLE) / 100 END AS b, CAST(length(b.text) AS DOUBLE) AS len
 FROM base b LEFT JOIN used u USING (doc_id))"""


def scope_filter(scopes: list[str] | None, column: str = "scope") -> Column:
    """None passes every row, an empty list none; a null scope counts as global."""
    if scopes is None:
        return F.lit(True)
    return F.coalesce(F.col(column), F.lit("global")).isin(scopes) if scopes else F.lit(False)


def updated(memories: DataFrame, changes: DataFrame, key: str = "doc_id") -> DataFrame:
    """memories with non-null values of changes (key and some columns) in place; ts and scope stay."""
    names = [c for c in changes.columns if c != key]
    renamed = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in names))
    joined = memories.join(renamed, key, "left")
    return joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in names else F.col(c) for c in memories.columns))


def not_found(memories: DataFrame, changes: DataFrame, key: str = "doc_id") -> DataFrame:
    return changes.select(key).join(memories.select(key), key, "left_anti")
