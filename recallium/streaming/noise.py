"""Noise prototypes that a stream learns: vectors of texts that gave nothing, of which only the newest different ones stay.

The stream's sink is its own filter. Each batch is held against the fixed prototypes and the version of the learned ones that the batch
before left; what is near to one of them is dropped where it lies, and only the rest is folded in order, by a task that holds no more
than the prototypes. The result is a new version, named by the batch, so a batch that is run again replaces itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallium.functions import vector as V
from recallium.sources.versions import Files

# Nearness that makes noise, nearness that makes a new prototype needless, nearness of the first two fixed ones that makes
# the bank useless, number of learned prototypes.
NOISE, KNOWN, DEGENERATE, MOST_LEARNED = 0.82, 0.90, 0.98, 200
_SCHEMA = "place long, vector array<double>"


def usable(fixed: DataFrame) -> bool:
    """Whether the fixed prototypes (place, vector; a small configured table) tell texts apart."""
    first = [r["vector"] for r in fixed.where(F.size("vector") > 0).orderBy("place").limit(2).collect()]
    if len(first) < 2:
        return bool(first)
    a, b = (np.array(v, float) / max(np.linalg.norm(v), 1e-300) for v in first)
    return float(a @ b) <= DEGENERATE


def learned(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """place, vector: the newest version of the learned prototypes, or the newest of a batch before the given one."""
    made = [int(n.split("=")[1]) for n in Files(spark).children(path) if n.startswith("version=")]
    made = [n for n in made if before is None or n < before]
    return spark.read.schema(_SCHEMA).parquet(f"{path}/version={max(made)}") if made else spark.createDataFrame([], _SCHEMA)


def prototypes(spark: SparkSession, fixed: DataFrame, path: str) -> DataFrame:
    """vector: what texts are held against now; none where the fixed ones are of no use."""
    if not usable(fixed):
        return fixed.select("vector").limit(0)
    return fixed.select(F.col("vector").cast("array<double>").alias("vector")).unionByName(learned(spark, path).select("vector"))


def is_noise(rows: DataFrame, bank: DataFrame, threshold: float = NOISE, id_column: str = "doc_id") -> DataFrame:
    """id, best (nearness to the closest prototype), is_noise. rows: id, vector; bank: vector, as of prototypes()."""
    near = V.best_of(rows, bank.select(F.monotonically_increasing_id().alias("qid"), "vector"), id_column)
    return near.select(id_column, F.col("cos").alias("best"), (F.col("cos") >= threshold).alias("is_noise"))


def _unit(v) -> np.ndarray:
    v = np.asarray(v, float)
    return v / max(np.linalg.norm(v), 1e-300)


def fold(fixed: list, old: list[tuple], most: int = MOST_LEARNED):
    """A pass over vectors in order: each is learned unless one at KNOWN or nearer is there; beyond `most` the oldest goes."""
    kept = [(p, _unit(v)) for p, v in old]
    solid = [_unit(v) for v in fixed if len(v)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bank = list(kept)
        for frame in frames:
            for place, v in zip(frame["place"], frame["vector"], strict=True):
                u = _unit(v)
                against = [x for x in solid if len(x) == len(u)] + [x for _, x in bank if len(x) == len(u)]
                if not against or max(np.stack(against) @ u) < KNOWN:
                    bank = [*bank, (int(place), u)][-most:]
        yield pd.DataFrame({"place": [p for p, _ in bank], "vector": [list(map(float, v)) for _, v in bank]})

    return run


def learn_batch(spark: SparkSession, batch: DataFrame, batch_id: int, fixed: DataFrame, path: str, most: int = MOST_LEARNED) -> None:
    """One batch (place, vector; place gives the order) into the next version."""
    if not usable(fixed):
        return
    old = learned(spark, path, batch_id)
    solid = [r["vector"] for r in fixed.select("vector").collect()]  # configured
    held = [(r["place"], r["vector"]) for r in old.orderBy("place").collect()]  # at most `most`
    new = batch.where(F.size("vector") > 0).select("place", F.col("vector").cast("array<double>").alias("vector"))
    near = V.best_of(new, spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(solid)], "qid long, vector array<double>"), "place")
    fresh = new.join(near.where(F.col("cos") < KNOWN).select("place"), "place", "left_semi")
    # learned prototypes may go while the batch is folded, so only the fixed ones drop rows beforehand; one task, but with few and short rows
    fresh.repartition(1).sortWithinPartitions("place").mapInPandas(fold(solid, held, most), _SCHEMA).write.mode("overwrite").parquet(f"{path}/version={batch_id}")


def learn_noise(vectors: DataFrame, fixed: DataFrame, path: str, checkpoint: str, most: int = MOST_LEARNED):
    """Starts the stream over vectors (place, vector) into the versions below path."""
    write = lambda batch, batch_id: learn_batch(batch.sparkSession, batch, batch_id, fixed, path, most)
    return vectors.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
