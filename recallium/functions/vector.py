"""Vector functions: cosine similarity as a native expression, blocked k-NN, random hyperplane signatures."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries of one block; their matrix is what a task gets broadcast.
QUERY_BLOCK = 4096
#: Queries, and rows of a batch, that are compared at once: what a task holds of their cosines.
TILE, ROWS = 256, 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, different lengths and zero norms."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms), F.lit(0.0))


def knn(corpus: DataFrame, queries: DataFrame, k: int, id_column: str = "doc_id", group: str | None = None) -> DataFrame:
    """qid, id, cos of each query's k nearest rows, ties by id. corpus: id, vector; queries: qid, vector. With a group column, which both
    have, only rows of the query's group count (null is a group).

    A task keeps the best k rows of each query while it reads, and gives them out once, so tasks times queries times k rows at most are
    shuffled; queries go in blocks of bounded size."""
    order = Window.partitionBy("qid").orderBy(F.desc("cos"), "id")
    rows = corpus.select(F.col(id_column).alias("id"), "vector", (F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("grp"))
    asked, out = queries.select("qid", "vector", (F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("grp")), None
    for block in _blocks(asked):
        part = _knn_block(rows, block, k)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumnRenamed("id", id_column)


def _blocks(queries: DataFrame) -> Iterator[list[tuple]]:
    """The rows of queries (qid first), about QUERY_BLOCK at a time, by a hash of qid; at least one block."""
    n = max(1, -(-queries.count() // QUERY_BLOCK))
    for i in range(n):
        yield [tuple(r) for r in queries.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i).collect()]


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of the vectors, zeros for those of another length, and which rows have the length."""
    fit = np.array(column.value_lengths().fill_null(0)) == dim
    x = np.zeros((len(column), dim))
    x[fit] = column.filter(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norms > 0, norms, 1), fit


def _packed(block: list[tuple]) -> tuple[list, np.ndarray]:
    """The first values and the vectors (the second ones) of a block, as a matrix."""
    return [r[0] for r in block], np.array([r[1] for r in block], float).reshape(len(block), -1 if block else 0)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, at most ROWS at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _tiles(n: int) -> Iterator[slice]:
    return (slice(at, at + TILE) for at in range(0, n, TILE))


def _broadcast_blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    """qids and vectors of the queries, so many at a time; nothing where there are none."""
    for block in _blocks(queries.select("qid", "vector")):
        if block:
            yield _packed(block)


def best_of(corpus: DataFrame, queries: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """id, cos: each row's greatest cosine to any of the queries."""
    rows, out = corpus.select(F.col(id_column).alias("id"), "vector"), None
    for block in _broadcast_blocks(queries):
        shared = corpus.sparkSession.sparkContext.broadcast(block[1])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = _unit(shared.value)
            for batch in _slices(batches):
                x, _ = _matrix(batch.column("vector"), m.shape[1])
                best = functools.reduce(np.maximum, ((x @ m[tile].T).max(1) for tile in _tiles(len(m))))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(best)], ["id", "cos"])

        part = rows.mapInArrow(run, "id long, cos double")
        out = part if out is None else out.unionByName(part)
    out = rows.select("id", F.lit(0.0).alias("cos")).limit(0) if out is None else out
    return out.groupBy("id").agg(F.max("cos").alias("cos")).withColumnRenamed("id", id_column)


def nearest_other(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, cos: each query's greatest cosine to a row whose vector is another; tasks keep one number a query."""
    out = None
    for block in _broadcast_blocks(queries):
        shared = corpus.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qids, raw = shared.value
            m, best, of = _unit(raw), np.full(len(qids), -np.inf), {}
            for i, v in enumerate(raw):
                of.setdefault(v.tobytes(), []).append(i)
            for batch in _slices(batches):
                column = batch.column("vector")
                x, fit = _matrix(column, raw.shape[1])
                values = column.filter(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).reshape(-1, raw.shape[1]).astype(float)
                same = [(i, j) for j, v in zip(np.flatnonzero(fit), values, strict=True) for i in of.get(v.tobytes(), ())]
                i, j = np.array(same, np.int64).reshape(-1, 2).T
                for tile in _tiles(len(m)):
                    cos = m[tile] @ x.T
                    here = (i >= tile.start) & (i < tile.stop)
                    cos[i[here] - tile.start, j[here]] = -np.inf
                    best[tile] = np.maximum(best[tile], cos.max(1))
            found = np.flatnonzero(best > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array([qids[i] for i in found], pa.int64()), pa.array(best[found])], ["qid", "cos"])

        part = corpus.select("vector").mapInArrow(run, "qid long, cos double")
        out = part if out is None else out.unionByName(part)
    out = queries.select("qid", F.lit(0.0).alias("cos")).limit(0) if out is None else out
    return out.groupBy("qid").agg(F.max("cos").alias("cos"))


#: Rows of a bucket that are aimed at, rows of a bucket that are compared by one task, chance to find a pair at the threshold.
PER_BUCKET, MOST_IN_BUCKET, RECALL = 64, 2048, 0.999


def bucket_plan(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for n vectors: so many signs that a bucket holds about PER_BUCKET of n vectors without order, and so many tables
    that a pair at the threshold, whose signs agree one by one with the chance 1 - angle / pi, shares a bucket with the given chance."""
    bits = min(24, max(4, math.ceil(math.log2(max(2, n / PER_BUCKET)))))
    together = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - together))) if together < 1 else 1


def near_pairs(rows: DataFrame, threshold: float, recall: float = RECALL, seed: int = 5, most: int = MOST_IN_BUCKET) -> DataFrame:
    """a, b, cos of all pairs of rows (id, vector) with a cosine of at least threshold, but for those that no bucket brings together: at
    the threshold a share of 1 - recall, above it less. Rows meet in buckets of signs of random directions, whose number follows the number
    of rows. They are compared where they meet, so only pairs that are near leave a task; a bucket of more than `most` rows is cut into
    blocks, of which every two are compared by a task of their own. Vectors must differ from each other: equal ones would meet in every
    bucket."""
    bits, tables = bucket_plan(rows.count(), threshold, recall)

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, powers = None, 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            sizes = np.array(batch.column("vector").value_lengths().fill_null(0))
            for dim in sorted(set(sizes.tolist()) - {0}):
                part = batch.filter(pa.array(sizes == dim))
                if planes is None or planes.shape[0] != dim:
                    planes = np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))
                x, _ = _matrix(part.column("vector"), dim)
                keys = ((x @ planes > 0).reshape(len(x), tables, bits) @ powers) + (np.arange(tables, dtype=np.int64) << bits) + (dim << 40)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(list(x), pa.list_(pa.float64())), pa.array(list(keys), pa.list_(pa.int64()))], ["id", "x", "keys"])

    found = rows.select("id", "vector").mapInArrow(signs, "id long, x array<double>, keys array<long>")
    large = found.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    large = F.broadcast(large.select("key", F.ceil(F.col("n") / most).cast("int").alias("blocks")))  # at most rows * tables / most
    placed = found.select("id", "x", F.explode("keys").alias("key")).join(large, "key", "left").withColumn("block", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("blocks"))).cast("int"))
    others = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = placed.withColumn("other", F.explode(others)).select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "x")

    def near(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, block = part.column("id").to_numpy(), part.column("block").to_numpy()
        x = np.array(part.column("x").combine_chunks().flatten()).reshape(len(ids), -1)
        left, right = (np.flatnonzero(block == part.column(c)[0].as_py()) for c in ("lo", "hi"))
        out = []
        for at in range(0, len(left), 512):
            some = left[at : at + 512]
            cos = x[some] @ x[right].T
            i, j = np.nonzero(cos >= threshold)
            a, b = ids[some[i]], ids[right[j]]
            keep = a < b if part.column("lo")[0] == part.column("hi")[0] else a != b
            out.append((np.minimum(a, b)[keep], np.maximum(a, b)[keep], cos[i, j][keep]))
        return tuple(np.concatenate(z) for z in zip(*out, strict=True))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held is None or not held.num_rows:
                continue
            names = np.stack([held.column(c).to_numpy().astype(np.int64) for c in ("key", "lo", "hi")], 1)
            cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1).tolist(), held.num_rows]
            whole = len(cuts) - 1 if batch is None else len(cuts) - 2  # the last group may go on in the next batch
            pairs = [near(held.slice(a, b - a)) for a, b in zip(cuts[:whole], cuts[1 : whole + 1], strict=True) if b - a > 1]
            held = held.slice(cuts[whole])
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*pairs, strict=True)], ["a", "b", "cos"])

    met = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(compare, "a long, b long, cos double")
    return met.groupBy("a", "b").agg(F.max("cos").alias("cos"))


def over_blocks(queries: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that run gives for all queries (with a qid), in blocks of about QUERY_BLOCK; each query is in one block, by a hash."""
    blocks, out = max(1, -(-queries.count() // QUERY_BLOCK)), None
    for i in range(blocks):
        part = run(queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i))
        out = part if out is None else out.unionByName(part)
    return out


def _knn_block(corpus: DataFrame, block: list[tuple], k: int) -> DataFrame:
    """qid, id, cos: the best k rows of each task for each query of the block (qid, vector, group)."""
    shared = corpus.sparkSession.sparkContext.broadcast((*_packed(block), [g for _, _, g in block]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, vectors, wanted = shared.value
        if not asked or not k:
            return
        m = _unit(vectors)
        codes = {g: i for i, g in enumerate(dict.fromkeys(wanted))}
        own = np.array([codes[g] for g in wanted])
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) for _ in range(0, len(asked), TILE)]  # query, id, cos of each tile
        least = np.full(len(asked), -np.inf)
        for batch in _slices(batches):
            ids = np.array(batch.column("id").to_pylist(), np.int64)
            x, _ = _matrix(batch.column("vector"), m.shape[1])
            groups = np.array([codes.get(g, -1) for g in batch.column("grp").to_pylist()])
            for t, at in enumerate(range(0, len(asked), TILE)):
                to = min(at + TILE, len(asked))
                cos = np.round(m[at:to] @ x.T, 12)
                if len(codes) > 1 or (groups < 0).any():
                    cos[own[at:to, None] != groups[None, :]] = -np.inf
                bound = least[at:to]
                if cos.shape[1] > k:
                    bound = np.maximum(bound, np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k])
                q, j = np.nonzero((cos >= bound[:, None]) & (cos > -np.inf))
                of, id_, c = (np.concatenate(z) for z in zip(best[t], (q + at, ids[j], cos[q, j]), strict=True))
                order = np.lexsort((id_, -c, of))
                of, id_, c = of[order], id_[order], c[order]
                place = np.arange(len(of)) - np.searchsorted(of, of)
                keep = place < k
                best[t] = of[keep], id_[keep], c[keep]
                full = keep & (place == k - 1)
                least[of[full]] = c[full]
        for of, id_, c in best:
            yield pa.RecordBatch.from_arrays([pa.array([asked[i] for i in of.tolist()], pa.int64()), pa.array(id_), pa.array(c)], ["qid", "id", "cos"])

    return corpus.mapInArrow(run, "qid long, id long, cos double")


def hyperplanes(k: int, dim: int, seed: int = 42) -> list[list[float]]:
    """k unit normals from a 32-bit generator (mulberry32) and the Box-Muller transform."""
    state = seed & 0xFFFFFFFF

    def uniform() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((state ^ (state >> 15)) * (state | 1)) & 0xFFFFFFFF
        t ^= (t + ((t ^ (t >> 7)) * (t | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF
        return ((t ^ (t >> 14)) & 0xFFFFFFFF) / 4294967296

    out = []
    for _ in range(k):
        v = [math.sqrt(-2 * math.log(uniform() or 1e-10)) * math.cos(2 * math.pi * uniform()) for _ in range(dim)]
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        out.append([x / norm for x in v])
    return out


def signature(vector: Column, planes: list[list[float]]) -> Column:
    """Bit i is set where the vector lies on the positive side of plane i."""
    out = F.lit(0)
    for i, p in enumerate(planes):
        out = out + F.when(dot(vector, F.array(*map(F.lit, p))) >= 0, F.lit(1 << i)).otherwise(0)
    return out
