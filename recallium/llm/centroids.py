"""Centroid clustering in exact integers, screened by block norms.

Each vector is compressed to the norms of its segments. By Cauchy-Schwarz the squared distance of a vector x and a centroid c is at
least |x|^2 + |c|^2 - 2 * sum over segments of |x_s| * |c_s|. The centroid of the least bound is measured exactly; of the others only
those whose bound does not exceed that distance are. Bounds are floating-point with a margin, distances and means are integers.

Rounds run over a stored table; a task returns a count and the sums of each cluster, and only the centroids, k rows of fixed length, go to
the driver and out by broadcast.

Defined cases: vectors of another length, with a null or non-finite component, or with a component whose integer is beyond +-2^27
(whose distances need more than 64 bits) are left out. Repeated rows count each; equal ids are told apart by their components, and
equal rows are alike. A null vec_id is hashed as '3:'. With fewer vectors than clusters there are as many clusters as vectors; an empty
table gives no rows. A sum of distances beyond 64 bits is null."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from recallium.llm.common import Staged

SCALE = 1024
SEGMENT = 8
#: Components up to this keep every distance of 64 components within 64 bits.
GREATEST = 1 << 27


def integer_vectors(embeddings: DataFrame, dim: int) -> DataFrame:
    """vec_id, x: the components times SCALE, rounded down, of each vector that fits; norms: those of its segments."""
    values = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.floor(v * SCALE))
    usable = F.forall("embedding", lambda v: v.isNotNull() & (F.floor(F.abs(v.cast("double")) * SCALE) < GREATEST) & ~F.isnan(v.cast("double")))
    kept = embeddings.where((F.size("embedding") == dim) & usable).select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("x"))
    squares = F.array(*(F.aggregate(F.slice("x", at + 1, SEGMENT), F.lit(0).cast("long"), lambda s, v: s + v * v) for at in range(0, dim, SEGMENT)))
    return kept.select("vec_id", F.col("x").cast("array<int>").alias("x"), F.transform(squares, lambda s: F.sqrt(s.cast("double"))).alias("norms"))


def segment_norms(vectors: np.ndarray) -> np.ndarray:
    at = np.arange(0, vectors.shape[1], SEGMENT)
    return np.sqrt(np.add.reduceat(vectors.astype(float) ** 2, at, axis=1))


def nearest(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each vector the nearest centroid (the smaller number where two are as near), the squared distance, and how many exact
    distances were taken in all."""
    n, k = len(x), len(centroids)
    of = segment_norms(centroids)
    size = (norms**2).sum(1)[:, None] + (of**2).sum(1)[None, :]
    bound = size - 2 * norms @ of.T - (1e-9 * size + 1)  # the margin is far above what rounding can lose
    first = bound.argmin(1)
    exact = np.full((n, k), np.iinfo(np.int64).max)

    def measure(rows: np.ndarray, columns: np.ndarray) -> None:
        away = x[rows] - centroids[columns]
        exact[rows, columns] = np.einsum("ij,ij->i", away, away)

    every = np.arange(n)
    measure(every, first)
    open_ = bound <= exact[every, first][:, None]
    open_[every, first] = False
    measure(*np.nonzero(open_))
    best = exact.argmin(1)
    return best, exact[every, best], n + int(open_.sum())


def _arrays(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    flat = lambda name: batch.column(name).flatten().to_numpy(zero_copy_only=False)
    return flat("x").astype(np.int64).reshape(-1, dim), flat("norms").reshape(batch.num_rows, -1)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: means of their vectors, rounded down; those without vectors stay."""
    k, dim = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            x, norms = _arrays(batch, dim)
            of, _, _ = nearest(x, norms, centroids)
            count += np.bincount(of, minlength=k)
            for c in np.unique(of):
                total[c] += x[of == c].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k, dtype=np.int32), dim)), pa.array(np.tile(np.arange(dim, dtype=np.int32), k)), pa.array(np.repeat(count, dim)), pa.array(total.ravel())], ["cluster", "at", "n", "part"])

    parts = vectors.select("x", "norms").mapInArrow(sums, "cluster int, at int, n long, part long")
    whole = parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("whole"))
    out = centroids.copy()
    for r in whole.where("n > 0").collect():  # a row for each component of a centroid
        out[r["cluster"], r["at"]] = int(r["whole"]) // r["n"]
    return out


def cluster(embeddings: DataFrame, dim: int = 64, k: int = 8, rounds: int = 10, salt: str = "3:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256. embeddings: vec_id, embedding."""
    spark = embeddings.sparkSession
    stored = Staged(integer_vectors(embeddings, dim), "centroid-vectors")
    vectors = stored.df
    order = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = vectors.orderBy(order, "x").limit(k).select("x").collect()  # k rows
    centroids = np.array([r["x"] for r in start], np.int64).reshape(len(start), dim)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(vectors, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, distance, _ = nearest(*_arrays(batch, dim), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(of.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    assigned = Staged(vectors.mapInArrow(assign, "vec_id long, cluster int, distance long"), "centroid-assigned").df
    stored.drop()
    inertia = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # one row a cluster
    fits = lambda v: v if v < 1 << 63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    table = [Row(cluster=c, cluster_inertia=fits(v), inertia=fits(sum(inertia.values())), centroid_sha256=digest(c)) for c, v in sorted(inertia.items())]
    return assigned.join(F.broadcast(spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
