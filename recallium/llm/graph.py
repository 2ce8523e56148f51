"""Connected components of a distributed graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallium.llm.common import Staged


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    sides = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return sides.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("c"), F.lit(0).alias("p")).unionByName(edges.select(F.col("b").alias("n"), F.lit(0).alias("c"), F.lit(1).alias("p")))
    return ends.groupBy("n").agg(F.sum("c").alias("c"), F.max("p").alias("p")).where("c > 1 or (c > 0 and p > 0)").isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> Staged:
    """edges (a, b) of long ids -> (a, b): every node but the least of its component, and that least. Each round is written
    to the shared folder, so that the lineage stays short."""
    now = Staged(_small(edges.where("a <> b").select("a", "b")), "components")
    for _ in range(rounds):
        if _is_forest_of_stars(now.df):
            return now
        after = Staged(_small(_large(now.df)), "components")
        now.drop()
        now = after
    raise RuntimeError("components did not settle")
