"""Measurements of operations: exact figures over the newest ones of each, and rollups by hour that merge into any longer time.

A record is one call: operation, at_ms, latency, failed, features (name -> score). A rollup row holds counts, sums, bounds and a quantile
sketch, so hours add up to days, and days to a whole, without the records: the merged sketch answers as one of all records would. A rank it
gives is off by at most RANK_ERROR of the number of records, with a chance of 99 % (sketches of K items)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECORDS = "operation string, event_id long, at_ms long, latency double, failed boolean, features map<string, double>"
#: Newest records of an operation that summaries look at.
RING = 500
K, RANK_ERROR = 200, 0.0165
HOUR, DAY = 3_600_000, 86_400_000


def newest(records: DataFrame, most: int = RING) -> DataFrame:
    """The newest records of each operation; of equal times those of greater ids."""
    order = Window.partitionBy("operation").orderBy(F.desc("at_ms"), F.desc("event_id"))
    return records.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= most).drop("_at")


def summary(records: DataFrame, most: int = RING) -> DataFrame:
    """operation, n, failures, mean, p95 (by nearest rank, exact), over the newest records; features: the mean of each score over all of these
    records, so a record without a feature counts as 0 for it."""
    rows = newest(records, most)
    latencies = F.array_sort(F.collect_list("latency"))  # at most `most`
    p95 = F.try_element_at(latencies, F.greatest(F.lit(1), F.ceil(F.size(latencies) * 0.95)).cast("int"))
    whole = rows.groupBy("operation").agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("failures"), F.avg("latency").alias("mean"), p95.alias("p95"))
    sums = rows.select("operation", F.explode("features").alias("name", "score")).groupBy("operation", "name").agg(F.sum("score").alias("total"))
    means = sums.join(whole.select("operation", "n"), "operation").groupBy("operation").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", (F.col("total") / F.col("n")).alias("mean"))))).alias("features"))
    return whole.join(means, "operation", "left")


def _rolled(rows: DataFrame, value: str) -> DataFrame:
    keys = ["operation", "feature", "hour"]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("failures"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"), F.kll_sketch_agg_double(value, K).alias("sketch"))


def by_hour(records: DataFrame) -> DataFrame:
    """operation, feature (null: latency), hour, n, failures, total, least, most, sketch. Null measurements and those that are no numbers are left
    out of their own row only."""
    hour = F.floor(F.col("at_ms") / HOUR) * HOUR
    base = records.select("operation", F.lit(None).cast("string").alias("feature"), hour.alias("hour"), "failed", F.col("latency").alias("x"))
    features = records.select("operation", hour.alias("hour"), "failed", F.explode("features").alias("feature", "x")).select("operation", "feature", "hour", "failed", "x")
    return _rolled(base.unionByName(features).where("x IS NOT NULL AND NOT isnan(x)"), "x")


def merged(rollups: DataFrame, *keys: Column | str) -> DataFrame:
    """Rollup rows of fewer keys: hours into whatever keys say, such as a day."""
    return rollups.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("failures").alias("failures"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantile(rank: float) -> Column:
    """The value at a rank from 0 to 1, from a rollup's sketch."""
    return F.kll_sketch_get_quantile_double("sketch", F.lit(rank))
