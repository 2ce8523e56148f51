"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last 7 bytes closes a chunk wherever its low bits are zero; the chunk then becomes one letter.
The number of bits (the block size is two to that power) is the smallest at which the text has at most 64 chunks, and a
second signature is made at twice the block size. Fingerprints compare where their block sizes meet: likeness is one
minus the edit distance over the longer signature, the best of the compatible pairs, and 0 where none is compatible.

Boundaries of a block size are boundaries of every smaller one, so all sizes come out of one pass of numpy over the
bytes of a batch. Edit distances are computed bit-parallel (Myers, Hyyrö), all pairs of a batch at once.

Defined cases: a null text is empty; the empty fingerprint is "0::" and two of them are alike (1.0); rows are ordered by
doc_id, null first, repeated ids by their text; the row after the last is the first, and a single row follows itself;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallium.llm.common import with_id

WINDOW, MOST = 7, 64
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Bytes hashed at once; longer texts are hashed alone.
BLOCK = 1 << 21
_M = np.uint32(0x9E3779B1)
_POWERS = [np.uint32(pow(0x9E3779B1, k, 1 << 32)) for k in range(7)]
_TABLE = np.random.default_rng(7).integers(1, 1 << 32, 256, dtype=np.uint32)
_TABLE[0] = 0
_CODE = np.frombuffer(LETTERS.encode(), np.uint8)
_DIGIT = np.zeros(256, np.uint8)
_DIGIT[_CODE] = np.arange(64)


def _rolled(data: np.ndarray) -> np.ndarray:
    """At each byte a mixed hash of it and the six before it."""
    t = _TABLE[data]
    two = t.copy()
    two[1:] += t[:-1] * _M
    four = two.copy()
    four[2:] += two[:-2] * _POWERS[2]
    h = four
    seven = h.copy()
    seven[4:] += two[:-4] * _POWERS[4]
    seven[6:] += t[:-6] * _POWERS[6]
    seven ^= seven >> np.uint32(15)
    seven *= np.uint32(0x85EBCA6B)
    seven ^= seven >> np.uint32(13)
    seven *= np.uint32(0xC2B2AE35)
    seven ^= seven >> np.uint32(16)
    return seven


def _hashed(texts: list[bytes]) -> list[tuple[int, bytes, bytes]]:
    """Texts short enough to be hashed together; zero bytes keep them apart."""
    pad = bytes(WINDOW)
    data = np.frombuffer(pad + pad.join(texts) + pad, np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(np.concatenate(([WINDOW], sizes[:-1] + WINDOW)))
    h = _rolled(data)
    sums = np.cumsum(h, dtype=np.uint32)
    zeros = np.bitwise_count((h & (~h + np.uint32(1))) - np.uint32(1))  # low zero bits; 32 for h = 0
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = np.arange(len(owner)) + np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    z = zeros[inside]
    # boundaries of each text by their number of low zero bits; a chunk also ends with the text
    tally = np.bincount(owner * 34 + z, minlength=34 * len(texts)).reshape(-1, 34)
    at_least = tally[:, ::-1].cumsum(1)[:, ::-1]
    level = (at_least[:, : 33] >= MOST).sum(1)  # counts fall with the level: the first that has fewer than MOST
    chars = []
    for more in (0, 1):
        k = np.minimum(level + more, 33)
        hit = np.flatnonzero(z >= k[owner])
        who, where = owner[hit], inside[hit]
        ends = starts + sizes - 1
        last = sizes > 0
        who, where = np.concatenate((who, np.flatnonzero(last))), np.concatenate((where, ends[last]))
        order = np.lexsort((where, who))
        who, where = who[order], where[order]
        fresh = np.ones(len(who), bool)
        fresh[1:] = (who[1:] != who[:-1]) | (where[1:] != where[:-1])
        who, where = who[fresh], where[fresh]
        first = np.ones(len(who), bool)
        first[1:] = who[1:] != who[:-1]
        before = np.where(first, starts[who] - 1, np.concatenate(([0], where[:-1])))
        chunk = (sums[where] - sums[before]) * _M
        letters = _CODE[(chunk >> np.uint32(26)).astype(np.int64)].tobytes()
        cuts = np.searchsorted(who, np.arange(len(texts) + 1)).tolist()
        chars.append([letters[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
    return list(zip(level.tolist(), *chars, strict=True))


def hashed(texts: list[bytes]) -> list[tuple[int, bytes, bytes]]:
    """(level, signature, signature at twice the block size) of each text."""
    out, held, size = [], [], 0
    for t in texts:
        if held and size + len(t) > BLOCK:
            out += _hashed(held)
            held, size = [], 0
        held.append(t)
        size += len(t)
    return out + (_hashed(held) if held else [])


def shown(fingerprint: tuple[int, bytes, bytes]) -> str:
    return f"{fingerprint[0]}:{fingerprint[1].decode()}:{fingerprint[2].decode()}"


def parsed(text: str) -> tuple[int, bytes, bytes]:
    level, one, two = text.split(":")
    return int(level), one.encode(), two.encode()


def _matrix(signatures: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    width = MOST
    joined = b"".join(s.ljust(width, b"A") for s in signatures)
    return _DIGIT[np.frombuffer(joined, np.uint8)].reshape(-1, width), np.array([len(s) for s in signatures], np.int64)


def edit_distances(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Of each pair, whose signatures have 64 letters at most."""
    n = len(left)
    if not n:
        return np.zeros(0, np.int64)
    a, la = _matrix(left)
    b, lb = _matrix(right)
    eq = np.zeros((n, 64), np.uint64)
    rows = np.arange(n)
    for i in range(int(la.max())):
        on = rows[i < la]
        eq[on, a[on, i]] |= np.uint64(1 << i)
    one = np.uint64(1)
    top = np.where(la > 0, la - 1, 0).astype(np.uint64)
    pv, mv, score = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64), la.copy()
    for j in range(int(lb.max())):
        live = j < lb
        e = eq[rows, b[:, j]]
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph, mh = mv | ~(xh | pv), pv & xh
        score += np.where(live, ((ph >> top) & one).astype(np.int64) - ((mh >> top) & one).astype(np.int64), 0)
        ph, mh = (ph << one) | one, mh << one
        pv, mv = np.where(live, mh | ~(xv | ph), pv), np.where(live, ph & xv, mv)
    return np.where(la == 0, lb, score)


def likeness(left: list[tuple[int, bytes, bytes]], right: list[tuple[int, bytes, bytes]]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints."""
    pairs: list[tuple[int, bytes, bytes]] = []
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        if x[0] == y[0]:
            pairs += [(i, x[1], y[1]), (i, x[2], y[2])]
        elif x[0] + 1 == y[0]:
            pairs.append((i, x[2], y[1]))
        elif y[0] + 1 == x[0]:
            pairs.append((i, x[1], y[2]))
    out = np.zeros(len(left))
    if pairs:
        who, a, b = zip(*pairs, strict=True)
        longest = np.array([max(len(p), len(q)) for p, q in zip(a, b, strict=True)])
        each = 1.0 - edit_distances(list(a), list(b)) / np.maximum(longest, 1)
        np.maximum.at(out, np.array(who), each)
    return out


class _Chain:
    """Fingerprints of rows that come in order, each finished when its successor is there."""

    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")

    def __init__(self):
        self.held = None  # (doc_id, text, bytes, fingerprint)

    def feed(self, ids: list, texts: list[str], only_close: list[bool], out: list) -> None:
        """only_close: rows that close their predecessor and are not reported themselves."""
        data = [t.encode() for t in texts]
        rows = list(zip(ids, texts, data, hashed(data), only_close, strict=True))
        chain = ([self.held] if self.held else []) + rows
        pairs = [(x, y) for x, y in zip(chain, chain[1:], strict=False) if not x[4]]
        edits = []
        for x, y in pairs:
            n = len(x[1]) // 4
            edits.append((x[1][: len(x[1]) - n] + y[1][:n]).encode())
        prints = hashed(edits)
        own, after = [x[3] for x, _ in pairs], [y[3] for _, y in pairs]
        for (x, _), e, p, a, b in zip(pairs, edits, prints, likeness(own, prints), likeness(own, after), strict=True):
            out.append((x[0], len(x[1]), hashlib.sha256(e).hexdigest(), shown(x[3]), shown(p), float(a), float(b)))
        self.held = chain[-1] if chain else None


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Each row's fingerprint, that of its text edited with its successor's head, and both likenesses.

    Rows are dealt to ranges of doc_id. The first row of a range is also sent to the range before it, so that the last
    row there finds its successor; no row passes through a single task. The cuts are approximate quantiles, at most as
    many as there are partitions, and the heads are as many rows.
    """
    spark = docs.sparkSession
    n = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = with_id(docs).withColumn("text", F.coalesce("text", F.lit("")))
    quantiles = docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    cuts = sorted({int(q) for q in quantiles})
    # the number of cuts below the id: a range of its own for each cut; null goes first
    part = F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0), F.lit(0))
    docs = docs.withColumn("part", F.when(F.col("doc_id").isNull(), 0).otherwise(part))
    # two steps, so that texts are neither sorted nor shuffled to find the heads; the broadcast has a row for each cut
    docs = docs.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    least = docs.groupBy("part").agg(F.min("key").alias("key"))
    heads = docs.join(F.broadcast(least), ["part", "key"]).groupBy("part", "key").agg(F.min("text").alias("text"))
    order = Window.orderBy("part")
    heads = heads.select(
        F.coalesce(F.lag("part").over(order), F.max("part").over(Window.partitionBy())).alias("part"), F.lit(1).alias("close"), F.lit(None).cast("long").alias("doc_id"), "text"
    )
    rows = docs.select("part", F.lit(0).alias("close"), "doc_id", "text").unionByName(heads)
    dealt = rows.repartitionByRange(n, "part").sortWithinPartitions("part", "close", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, at = _Chain(), None
        for batch in batches:
            parts, close = batch.column("part").to_pylist(), batch.column("close").to_pylist()
            ids, texts, out = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), []
            i = 0
            while i < len(parts):
                if parts[i] != at:
                    chain, at = _Chain(), parts[i]
                j, size = i, 0
                while j < len(parts) and parts[j] == at and size < BLOCK:
                    size += len(texts[j])
                    j += 1
                chain.feed(ids[i:j], texts[i:j], [c == 1 for c in close[i:j]], out)
                i = j
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], list(_Chain.names))

    return dealt.mapInArrow(run, SCHEMA)
