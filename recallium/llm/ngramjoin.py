"""N-gram Jaccard join by MinHash banding.

Texts are sets of five-word shingles. Equal sets are one node from here on. A node's MinHash signature is cut into bands, as
many as the target recall at the threshold asks for; nodes meet that share a band. A bucket names its least node as hub and
every other node gets one edge to it, so buckets of any size give as many edges as they have rows. Components of these
edges hold every pair that shares a band; within them all pairs are verified on their full shingle sets:

* a component is dealt into blocks by set size and hash; pairs of blocks whose sizes can reach the threshold are verified
  in one task each, by products of sparse membership matrices; no pair is emitted, only each node's number of links and a
  spanning forest of the links found;
* components of the forests are the classes.

Node ids are 64-bit digests of the shingle sets. Buckets, clusters, classes and nodes that hold over a thousandth of all rows are
looked up by broadcast, the others by a shuffle (looked_up), so that no large group meets in one task.

Defined cases: a text of one to four words has one shingle, all its words; a null text or one without words has no
shingle, no link and a class of its own; repeated rows are copies of each other; a null id is carried, and a class's id is the
least id in it; an empty table gives no rows; other columns are ignored by classes() and kept by dedup().
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallium.llm.common import Memo, Staged, looked_up, utf8
from recallium.llm.graph import components
from recallium.llm.substrings import Bits, _bits

WORDS, THRESHOLD, RECALL, ROWS, BLOCK = 5, 0.8, 0.999, 7, 1000


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """The least number of bands that finds a pair at the threshold with this probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


def _word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def shingles(words: list[bytes], of, n: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the different n-word shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(of.__getitem__, words), np.uint64, len(words))
    size = min(n, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for j in range(size):
        out = (out ^ h[j : len(h) - size + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


class Signer:
    def __init__(self, rows: int, bands: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.rows, self.bands = rows, bands
        self.a = rng.integers(0, 1 << 31, rows * bands, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, rows * bands, dtype=np.uint32)

    def signature(self, sh: np.ndarray) -> np.ndarray:
        x = (sh ^ (sh >> np.uint64(32))).astype(np.uint32)
        out = np.full(len(self.a), np.uint32(0xFFFFFFFF))
        for i in range(0, len(x), 128):
            np.minimum(out, (x[i : i + 128, None] * self.a + self.b).min(0), out=out)
        return out

    def keys(self, sh: np.ndarray) -> np.ndarray:
        """One 64-bit key for each band."""
        sig = self.signature(sh).reshape(self.bands, self.rows).astype(np.uint64)
        key = np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for j in range(self.rows):
            key = (key ^ sig[:, j]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return key.view(np.int64)


def node_of(sh: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(sh.tobytes(), digest_size=8).digest(), "little", signed=True)


def verify(sets: list[np.ndarray], side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of sets at or above the threshold. side: 0 or 1, only pairs across sides; 2: all pairs."""
    sizes = np.array([len(s) for s in sets], np.float32)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    start = np.concatenate(([True], flat[1:] != flat[:-1]))
    column = np.cumsum(start) - 1
    shared = np.bincount(column) > 1
    keep = shared[column]
    owner, column = owner[keep], (np.cumsum(shared) - 1)[column[keep]]
    inter = np.zeros((len(sets), len(sets)), np.float32)
    width = max(256, (1 << 22) // max(1, len(sets)))
    ends = np.searchsorted(column, np.arange(0, int(column.max(initial=-1)) + 1 + width, width))
    for a, b in zip(ends, ends[1:], strict=False):
        if b > a:
            part = np.zeros((len(sets), width), np.float32)
            part[owner[a:b], column[a:b] - column[a]] = 1
            inter += part @ part.T
    union = sizes[:, None] + sizes[None, :] - inter
    i, j = np.nonzero(np.triu(inter >= threshold * union - 1e-4, 1))
    across = (side[i] == 2) | (side[j] == 2) | (side[i] != side[j])
    return i[across], j[across]


def _forest(n: int, i: list[int], j: list[int]) -> list[tuple[int, int]]:
    parent = list(range(n))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(i, j, strict=True):
        x, y = top(a), top(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _blocks(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows of one (cluster, pair) come together -> (node, links, other): links of a node, and forest edges."""

    def out(held):
        sets = [np.frombuffer(x[3], np.uint64) for x in held]
        side = np.array([x[4] for x in held])
        i, j = verify(sets, side, threshold)
        weight = np.array([x[5] for x in held], np.int64)
        links = np.bincount(i, weights=weight[j], minlength=len(held)) + np.bincount(j, weights=weight[i], minlength=len(held))
        forest = _forest(len(held), i.tolist(), j.tolist())
        nodes = [x[2] for x in held]
        some = np.flatnonzero(links).tolist()
        first = [nodes[k] for k in some] + [nodes[a] for a, _ in forest]
        other = [None] * len(some) + [nodes[b] for _, b in forest]
        return pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array([int(links[k]) for k in some] + [0] * len(forest), pa.int64()), pa.array(other, pa.int64())], ["node", "links", "other"])

    held: list[tuple] = []
    for batch in batches:
        for x in zip(*(batch.column(c).to_pylist() for c in ("cluster", "pair", "node", "set", "side", "n")), strict=True):
            if held and (x[0], x[1]) != (held[0][0], held[0][1]):
                if len(held) > 1:
                    yield out(held)
                held = []
            held.append(x)
    if len(held) > 1:
        yield out(held)


def linked(rows: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, words: int = WORDS, rows_a_band: int = ROWS, block: int = BLOCK) -> tuple[DataFrame, DataFrame, int]:
    """rows (uid, doc_id, text) -> (uid, doc_id, node), the nodes (node, n, least, first, links, class), and how many rows there are.

    n: rows of the node, least: their least id, first: the id (null last) and uid of the row that dedup() keeps, links: rows of other
    nodes at or above the threshold (null: none), class: the least node of the class."""
    bands = bands_for(threshold, recall, rows_a_band)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, signer, seen = Memo(_word_hash), Signer(rows_a_band, bands), set()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                nodes, keys = [], []
                for t in utf8(batch.column("text")):
                    sh = shingles(t.split(), of, words)
                    node = node_of(sh) if len(sh) else None
                    nodes.append(node)
                    new = node is not None and node not in seen
                    if new:
                        seen.add(node)
                    keys.append(signer.keys(sh) if new else None)
                of.trim()
                yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["uid", "doc_id", "node", "keys"])

    found = Staged(rows.mapInArrow(first, "uid long, doc_id long, node long, keys array<long>"), "minhash").df
    total = found.count()
    keyed = found.where(F.col("keys").isNotNull()).select("node", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count(F.lit(1)).alias("weight")).where("hub < last").select("key", "hub", "weight")
    edges = looked_up(keyed, buckets, "key", total, "inner").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    stored_near = components(edges)
    near = stored_near.df
    cluster = near.select(F.col("a").alias("node"), F.col("b").alias("cluster")).unionByName(near.select(F.col("b").alias("node"), F.col("b").alias("cluster")).distinct())

    # shingle sets of the nodes in clusters only: a bit field of bounded size spares the others, the join leaves exactly these
    asked = cluster.select(F.col("node").alias("h"))
    bits = rows.sparkSession.sparkContext.broadcast(_bits(asked, asked.count()))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field: Bits = bits.value
        of, seen = Memo(_word_hash), set()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                nodes, sets = [], []
                for t in utf8(whole.slice(at, 1000).column("text")):
                    sh = shingles(t.split(), of, words)
                    if len(sh):
                        node = node_of(sh)
                        if node not in seen and field.has(np.array([node], np.int64))[0]:
                            seen.add(node)
                            nodes.append(node)
                            sets.append(sh.tobytes())
                of.trim()
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([len(s) // 8 for s in sets], pa.int32()), pa.array(sets, pa.binary())], ["node", "size", "set"])

    stored_sets = Staged(rows.mapInArrow(second, "node long, size int, set binary"), "shingles")
    sets = stored_sets.df
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first")
    copies = found.where(F.col("node").isNotNull()).groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), first_row)
    members = sets.select("node", "size").distinct().join(cluster, "node").join(copies.select("node", "n"), "node")
    # blocks: by size (within a factor of 1/threshold only neighbouring bins can link), then by hash
    stored_members = Staged(members.withColumn("bin", F.floor(F.log("size") / F.lit(-math.log(threshold))).cast("int")), "members")
    members = stored_members.df
    counted = members.groupBy("cluster", "bin").agg(F.count(F.lit(1)).alias("m"))
    shape = counted.groupBy("cluster").agg(F.sum("m").alias("m"), F.map_from_entries(F.collect_list(F.struct("bin", F.ceil(F.col("m") / block).cast("int")))).alias("parts"))
    placed = looked_up(members, shape.withColumn("weight", F.col("m")), "cluster", total, "inner")
    single = F.col("m") <= block
    at = lambda d: F.coalesce(F.try_element_at("parts", F.col("bin") + d), F.lit(0))
    own = F.pmod(F.xxhash64("node"), at(0)).cast("int")
    # a pair of blocks is named (bin, part, step, other part); the side tells which of the two a node is in
    named = lambda b, p, step, q, side: F.struct(F.concat_ws(":", b, p, F.lit(step), q).alias("pair"), side.alias("side"))
    up_to = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    same = F.transform(up_to(at(0)), lambda q: named(F.col("bin"), F.least(own, q), 0, F.greatest(own, q), F.when(own == q, 2).when(own < q, 0).otherwise(1)))
    upward = F.transform(up_to(at(1)), lambda q: named(F.col("bin"), own, 1, q, F.lit(0)))
    downward = F.transform(up_to(at(-1)), lambda q: named(F.col("bin") - 1, q, 1, own, F.lit(1)))
    pairs = F.when(single, F.array(F.struct(F.lit("").alias("pair"), F.lit(2).alias("side")))).otherwise(F.concat(same, upward, downward))
    dealt = placed.select("node", "cluster", "n", F.explode(pairs).alias("p")).select("node", "cluster", "n", "p.pair", "p.side")
    full = dealt.join(sets.select("node", "set").dropDuplicates(["node"]), "node")
    schema = "node long, links long, other long"
    results = Staged(full.repartition("cluster", "pair").sortWithinPartitions("cluster", "pair", "node").mapInArrow(lambda b: _blocks(b, threshold), schema), "links").df
    for done in (stored_near, stored_sets, stored_members):
        done.drop()
    classes = components(results.where(F.col("other").isNotNull()).select(F.col("node").alias("a"), F.col("other").alias("b"))).df
    links = results.groupBy("node").agg(F.sum("links").alias("links"))
    known = copies.join(links, "node", "left").join(classes.select(F.col("a").alias("node"), F.col("b").alias("class")), "node", "left")
    return found.select("uid", "doc_id", "node"), known.withColumn("class", F.coalesce("class", "node")), total


def classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (the least id of the class), class_size and n_links (other documents at or above the threshold) of each row."""
    found, nodes, total = linked(docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), **options)
    ids = nodes.groupBy("class").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size")).withColumn("weight", F.col("class_size"))
    named = looked_up(nodes.select("node", "n", "links", "class"), ids, "class", total, "inner").withColumn("weight", F.col("n"))
    rows = looked_up(found.where("node IS NOT NULL"), named, "node", total, "inner")
    known = rows.select("doc_id", "class_id", "class_size", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"))
    alone = found.where("node IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"))
    return known.unionByName(alone)


def dedup(docs: DataFrame, **options) -> DataFrame:
    """One row of each class, that of the least id, and all rows without words; columns stay. Rows are numbered once, in a stored
    copy, so that a lost executor cannot number them anew."""
    names = docs.columns
    marked = Staged(docs.select(F.monotonically_increasing_id().alias("uid"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")), "numbered").df
    found, nodes, _ = linked(marked.select("uid", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text")), **options)
    best = nodes.groupBy("class").agg(F.min("first").alias("best"))
    keep = best.select("best.uid").unionByName(found.where("node IS NULL").select("uid"))
    return marked.join(keep, "uid", "left_semi").select("row.*")
