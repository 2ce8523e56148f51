"""Shared helpers of the corpus operators: reading, staging and word splitting."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters; bytes.split() cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A machine-local folder is used in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if spark.sparkContext.master.startswith("local["):
            base = f"file://{tempfile.gettempdir()}/recallium-shared"
        else:
            base = spark.conf.get("spark.sql.warehouse.dir")
    return base.rstrip("/")


class Staged:
    """A table written to the shared folder, so that its lineage ends there and lost executors cost nothing."""

    def __init__(self, df: DataFrame, name: str, partition_by: list[str] | None = None):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/recallium/{name}-{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        with contextlib.suppress(Exception):
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The column's strings as bytes; null is the empty text."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def with_id(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns that an operator reads, so that other columns can have any name."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


#: A key is hot from one part in so many of all rows on.
HOT_SHARE = 1000


def looked_up(rows: DataFrame, table: DataFrame, key: str, total: int, how: str) -> DataFrame:
    """rows joined ("inner" or "left") to table, which has each key once and, as weight, how many rows hold it; weight is dropped.

    Keys of over total / HOT_SHARE rows are broadcast: their weights sum to the number of keyed rows, which is a fixed multiple of
    total, so they are bounded in number whatever the input. Their rows stay where they are; the other keys are joined by a shuffle."""
    is_hot = F.col("weight") * HOT_SHARE > total
    hot, cold = F.broadcast(table.where(is_hot).drop("weight")), table.where(~is_hot).drop("weight")
    others = rows.join(F.broadcast(table.where(is_hot).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(others.join(cold, key, how))


class Memo(dict):
    """A dict that computes what it lacks; trim() bounds it between batches."""

    def __init__(self, compute, limit: int = 400_000):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        value = self[key] = self.compute(key)
        return value

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()


class Laid:
    """Sequences that are laid end to end, side by side in the order of time: the tokens of step t are one run, those of the
    longest sequences first. places: where each such token is in the end-to-end order."""

    def __init__(self, sizes: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        long = sizes[self.order]
        starts = (np.cumsum(sizes) - sizes)[self.order]
        steps = int(long[0]) if len(long) else 0
        self.alive = np.searchsorted(-long, -np.arange(steps), side="left")  # how many sequences are longer than t
        self.at = np.cumsum(self.alive) - self.alive
        sequence = np.arange(int(self.alive.sum())) - np.repeat(self.at, self.alive)
        self.places = starts[sequence] + np.repeat(np.arange(steps), self.alive)

    def steps(self) -> list[tuple[int, int]]:
        """(number of sequences, first place) of each step."""
        return list(zip(self.alive.tolist(), self.at.tolist(), strict=True))
