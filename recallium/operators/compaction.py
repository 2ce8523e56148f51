"""Merging memories that say the same: greedy clusters, merged rows, duplicates inside a batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallium.functions import patterns as P
from recallium.functions import vector as V
from recallium.operators.stored import stored
from recallium.sources.memories import scope_filter
from recallium.sources.versions import Versions

PLANES = 16


def greedy_clusters(rows: DataFrame, dim: int, threshold: float = 0.88, least: int = 2) -> DataFrame:
    """doc_id, seed of every row in a cluster of at least `least` rows. rows: doc_id, importance, vector; threshold below 1.

    Seeds go by importance, then id; a seed takes what is left in its hyperplane bucket with a cosine of the threshold or more.
    Equal vectors always fall together, so each different vector is one node: a bucket's task holds its different vectors,
    never its copies. Null, zero and differently sized vectors are in no cluster."""
    vector = F.transform("vector", lambda x: x.cast("double"))
    at = rows.select("doc_id", F.coalesce("importance", F.lit(0.0)).alias("importance"), vector.alias("vector"))
    at = at.where((F.size("vector") == dim) & (V.dot(F.col("vector"), F.col("vector")) > 0)).withColumn("bucket", V.signature(F.col("vector"), V.hyperplanes(PLANES, dim)))
    nodes = at.groupBy("bucket", "vector").agg(F.min(F.struct((-F.col("importance")).alias("down"), "doc_id")).alias("first"))

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["down", "doc_id"], ignore_index=True)
        x = np.stack(frame["vector"].to_list()).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        seed = np.full(len(x), -1)
        for i in range(len(x)):
            if seed[i] < 0:
                left = np.flatnonzero(seed < 0)
                seed[left[np.round(x[left] @ x[i], 12) >= threshold]] = i
        return pd.DataFrame({"bucket": frame["bucket"], "vector": frame["vector"], "seed": frame["doc_id"].to_numpy()[seed]})

    found = nodes.select("bucket", "vector", "first.*").groupBy("bucket").applyInPandas(one, "bucket int, vector array<double>, seed long")
    members = at.join(found, ["bucket", "vector"]).select("doc_id", "seed")
    large = members.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return members.join(large.select("seed"), "seed").select("doc_id", "seed")


def merged(members: DataFrame) -> DataFrame:
    """One row a cluster: seed, n, text, importance, category, scope. members: seed, doc_id, text, importance, category, scope.

    Lines are kept once without regard to case, the seed's first; the most frequent category wins, then the more important
    one, then the one met first; the scope is the seed's."""
    rank = F.struct((F.col("doc_id") != F.col("seed")).alias("later"), "doc_id")
    lines = members.select("seed", rank.alias("rank"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line")).withColumn("line", P.strip(F.col("line"))).where("line <> ''")
    first = lines.groupBy("seed", F.lower("line").alias("key")).agg(F.min(F.struct("rank", "pos", "line")).alias("first"))
    texts = first.groupBy("seed").agg(F.array_join(F.transform(F.sort_array(F.collect_list("first")), lambda x: x["line"]), "\n").alias("text"))
    votes = members.groupBy("seed", "category").agg(F.count(F.lit(1)).alias("n"), F.max("importance").alias("top"), F.min(rank).alias("met"))
    order = Window.partitionBy("seed").orderBy(F.desc("n"), F.desc("top"), "met")
    category = votes.withColumn("r", F.row_number().over(order)).where("r = 1").select("seed", "category")
    rest = members.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.least(F.lit(1.0), F.max("importance")).alias("importance"), F.max(F.when(F.col("doc_id") == F.col("seed"), F.col("scope"))).alias("scope"))
    return rest.join(category, "seed").join(texts, "seed", "left").select("seed", "n", F.coalesce("text", F.lit("")).alias("text"), "importance", "category", "scope")


def mean_vectors(members: DataFrame, dim: int) -> DataFrame:
    """seed, vector: the mean of the members' vectors, of length 1; what stands for a model's vector of the merged text."""
    at = members.select("seed", F.posexplode(F.transform("vector", lambda x: x.cast("double"))).alias("at", "x")).groupBy("seed", "at").agg(F.avg("x").alias("x"))
    whole = at.groupBy("seed").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("v"))
    norm = F.sqrt(V.dot(F.col("v"), F.col("v")))
    return whole.select("seed", F.when(norm > 0, F.transform("v", lambda x: x / norm)).otherwise(F.col("v")).alias("vector"))


@dataclass(frozen=True)
class Compaction:
    """What a run did, or would do."""

    scanned: int
    clusters: int
    deleted: int
    created: int
    version: int | None


def compact(memories: Versions, dim: int, before: int, scopes: list[str] | None = None, most: int = 200, threshold: float = 0.88, dry_run: bool = False, embed: Callable[[DataFrame, int], DataFrame] = mean_vectors) -> Compaction:
    """One run as one transaction: of the memories older than `before`, the oldest `most` are clustered; each cluster becomes a row with a vector
    of its own (embed(members with seed, text, vector; dim) -> seed, vector) and its members go. Readers see all of it or nothing; where another
    writer meanwhile changed a member's bucket the run is made anew. A dry run reads and plans the same and writes nothing.

    memories: doc_id, text, vector, importance, category, scope, ts, metadata. New ids are hashed from the seed and the members' number."""
    said: dict = {}

    def make(rows: DataFrame) -> tuple[DataFrame, DataFrame] | None:
        old = stored(rows.where((F.col("ts") < before) & scope_filter(scopes) & (F.size("vector") > 0)).orderBy("ts", "doc_id").limit(most))
        members = stored(greedy_clusters(old, dim, threshold).join(old, "doc_id"))
        counts = members.agg(F.count(F.lit(1)).alias("members"), F.countDistinct("seed").alias("clusters")).first()
        said.update(scanned=old.count(), clusters=counts["clusters"], members=counts["members"])
        if dry_run or not counts["clusters"]:
            return None
        note = F.to_json(F.struct(F.lit(True).alias("compacted"), F.col("n").alias("sourceCount"), F.lit(before).alias("compactedAt")))
        new = merged(members.drop("vector", "ts", "metadata")).join(embed(members, dim), "seed", "left")
        new = new.select(F.xxhash64(F.lit("compacted"), "seed", "n").alias("doc_id"), "text", "vector", "importance", "category", "scope", F.lit(before).cast("long").alias("ts"), note.alias("metadata"))
        names = {f.name: f.dataType for f in rows.schema}
        return members.select("doc_id"), new.select(*(F.col(n).cast(t).alias(n) for n, t in names.items()))

    version = memories.transact("compaction", make)
    done = version is not None
    return Compaction(said["scanned"], said["clusters"], said["members"] if done else 0, said["clusters"] if done else 0, version)


def batch_survivors(rows: DataFrame, threshold: float = 0.85) -> DataFrame:
    """batch, doc_id, survives. rows: batch, doc_id, vector. In order of ids, a row is a duplicate when an earlier survivor of
    its batch has a cosine above the threshold. A batch is what one extraction yields: a handful of rows."""
    item = F.struct("doc_id", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    none = F.array().cast("array<struct<doc_id:bigint,vector:array<double>>>")

    def step(kept, x):
        return F.when(F.exists(kept, lambda k: V.cosine(k["vector"], x["vector"]) > threshold), kept).otherwise(F.concat(kept, F.array(x)))

    batches = rows.select("batch", F.col("doc_id").cast("long").alias("doc_id"), "vector").groupBy("batch").agg(F.sort_array(F.collect_list(item)).alias("items"))
    kept = batches.withColumn("kept", F.transform(F.aggregate("items", none, step), lambda k: k["doc_id"]))
    return kept.select("batch", "kept", F.explode("items.doc_id").alias("doc_id")).select("batch", "doc_id", F.array_contains("kept", F.col("doc_id")).alias("survives"))
