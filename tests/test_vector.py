"""What a task holds while it compares a block of queries with a batch of rows."""

import tracemalloc
from types import SimpleNamespace
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pytest

from recallium.functions import vector

RUNS = {
    "nearest_other": lambda corpus: vector.nearest_other(corpus, MagicMock()),
    "best_of": lambda corpus: vector.best_of(corpus, MagicMock()),
    "knn": lambda corpus: vector.knn(corpus, MagicMock(), 20),
}


@pytest.mark.parametrize("name", RUNS)
def test_memory_of_a_full_block(spark, monkeypatch, name):
    """4096 queries against a batch of 10,000 rows: all cosines at once would take 328 MB."""
    rng = np.random.default_rng(3)
    asked, rows = rng.standard_normal((4096, 64)), rng.standard_normal((10000, 64))
    monkeypatch.setattr(vector, "_blocks", lambda _: iter([[(i, v, None) if name == "knn" else (i, v) for i, v in enumerate(asked.tolist())]]))
    held, corpus = [], MagicMock()
    corpus.select.return_value = corpus
    corpus.sparkSession.sparkContext.broadcast = lambda v: SimpleNamespace(value=v)
    corpus.mapInArrow = lambda f, schema: held.append(f) or MagicMock()
    RUNS[name](corpus)
    batch = pa.RecordBatch.from_arrays([pa.array(range(10000), pa.int64()), pa.array(list(rows), pa.list_(pa.float64())), pa.nulls(10000, pa.string())], ["id", "vector", "grp"])
    tracemalloc.start()
    out = pa.Table.from_batches(held[0](iter([batch])))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    cos = (asked / np.linalg.norm(asked, axis=1, keepdims=True)) @ (rows / np.linalg.norm(rows, axis=1, keepdims=True)).T
    if name == "knn":
        best = -np.sort(-np.array(out.column("cos")).reshape(4096, 20), axis=1)
        assert np.allclose(best, -np.sort(-cos, axis=1)[:, :20])
    else:
        assert np.allclose(out.column("cos"), cos.max(1 if name == "nearest_other" else 0))
    assert peak < 50e6
