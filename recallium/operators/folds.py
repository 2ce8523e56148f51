"""Sequential logic over the sorted rows of each key, as a stream: a task holds one row and one state at a time, so a key of any
number of rows needs no more memory than another."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def sorted_fold(rows: DataFrame, keys: list[str], order: list[str], step: Callable, column: str, kind: str) -> DataFrame:
    """rows with one more column. step(state, row) -> (state, value); state is None at the first row of a key, row a named tuple."""
    names = rows.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{column}` {kind}"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = state = None
        for frame in frames:
            values = []
            for row in frame.itertuples(index=False):
                now = tuple(getattr(row, k) for k in keys)
                if now != key:
                    key, state = now, None
                state, value = step(state, row)
                values.append(value)
            yield frame[names].assign(**{column: values})

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
