"""Chains of versions: which memory is the newest form of which, over the edges that memories keep of what they supersede."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallium.operators.stored import stored

RELATIONS = "array<struct<type: string, targetId: string>>"


def superseding_edges(memories: DataFrame) -> DataFrame:
    """id, next: what each memory was superseded by. memories: id, ts, relations (JSON text of [{type, targetId}]).

    An edge is said by either end, "supersedes" by the newer one, "superseded_by" by the older one. Where several memories supersede one,
    the latest counts (of equal times the greatest id); targets that are not there do not count. Malformed relations read as none."""
    said = memories.select("id", F.explode(F.from_json("relations", RELATIONS)).alias("r")).select("id", "r.type", "r.targetId").where("targetId IS NOT NULL")
    newer = said.where("type = 'supersedes'").select(F.col("targetId").alias("id"), F.col("id").alias("next"))
    older = said.where("type = 'superseded_by'").select("id", F.col("targetId").alias("next"))
    known = memories.select("id", "ts")
    edges = newer.unionByName(older).distinct().join(known.select("id"), "id", "left_semi")
    dated = edges.join(known.withColumnsRenamed({"id": "next", "ts": "next_ts"}), "next")
    return dated.groupBy("id").agg(F.max(F.struct("next_ts", "next"))["next"].alias("next"))


def heads(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """id, head, depth, in_loop of each of ids (id): the last memory of its chain and how many steps away it is. Memories that run into a
    loop have no head and no depth. edges: id, next; each id once, between ids that are there.

    Pointer doubling: in each round a row that points to an unfinished one leaps to where that one points, so a chain of n takes log2(n)
    rounds, each a join of the unfinished rows with all. Rows that see further than there are rows are in loops or before them."""
    steps = ids.select("id").distinct().join(edges, "id", "left")
    going_on = steps.where("next IS NOT NULL").select(F.col("id").alias("at"), F.lit(True).alias("more"))
    first = steps.select("id", F.coalesce("next", "id").alias("at"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("next").isNotNull().alias("moves"))
    rows = stored(first.join(going_on, "at", "left").select("id", "at", "depth", (F.col("moves") & F.col("more").isNotNull()).alias("open")))
    sees, total = 1, rows.count()
    while sees <= total and not rows.where("open").isEmpty():
        there = rows.select(F.col("id").alias("at"), F.col("at").alias("further"), F.col("depth").alias("steps"), F.col("open").alias("still"))
        leapt = rows.where("open").select("id", "at", "depth").join(there, "at").select("id", F.col("further").alias("at"), (F.col("depth") + F.col("steps")).alias("depth"), F.col("still").alias("open"))
        rows, sees = stored(rows.where("NOT open").unionByName(leapt)), 2 * sees
    return rows.select("id", F.when(~F.col("open"), F.col("at")).alias("head"), F.when(~F.col("open"), F.col("depth")).alias("depth"), F.col("open").alias("in_loop"))


def newest_versions(memories: DataFrame) -> DataFrame:
    """id, head, depth, in_loop of each memory (id, ts, relations)."""
    return heads(memories, superseding_edges(memories))
