"""Jobs on the whole table: backups, embedding anew, utility by a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def backup(rows: DataFrame, folder: str, day: str, keep: int = 7, most: int = 10_000) -> list[str]:
    """Writes the newest rows without vectors below folder/day; the latest `keep` days stay. Returns their names."""
    spark = rows.sparkSession
    rows.drop("vector").orderBy(F.desc("ts"), "doc_id").limit(most).write.mode("overwrite").json(f"{folder}/{day}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    days = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory())
    for old in days[:-keep]:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, old), True)
    return days[-keep:]


def embedded(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 32) -> DataFrame:
    """rows with a new vector. embed gets up to `batch` texts, each different text of an Arrow batch once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = list(dict.fromkeys(f["text"].fillna("")))
            vectors: dict[str, list[float]] = {}
            for i in range(0, len(texts), batch):
                vectors |= zip(texts[i : i + batch], embed(texts[i : i + batch]), strict=True)
            yield f.assign(vector=[vectors[t] for t in f["text"].fillna("")])

    plain = rows.drop("vector")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInPandas(run, f"{fields}, vector array<float>")


def re_embed(source: DataFrame, done: DataFrame | None, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """What a new table gets: rows that it does not have yet, embedded anew."""
    rows = source if done is None else source.join(done.select("id"), "id", "left_anti")
    return embedded(rows, embed)


def with_utility(rows: DataFrame, score: Callable[[list[str]], list[float | None]]) -> DataFrame:
    """rows with utility in 0..1 by a model; one half where the model fails or gives no number."""

    @F.pandas_udf("double")
    def utility(text: pd.Series) -> pd.Series:
        try:
            found = score(text.fillna("").tolist())
        except Exception:  # a model that does not answer must not stop the write
            found = [None] * len(text)
        return pd.to_numeric(pd.Series(found), errors="coerce").fillna(0.5).clip(0, 1)

    return rows.withColumn("utility", utility("text"))
