"""Suffix-array dedup: byte strings of a given length that stand in two places, over a whole corpus.

1. Anchors. Of all k-byte hashes within a window of `length` bytes the least (leftmost among equals) is the window's anchor.
   Equal windows have their anchors at the same place, so equal windows meet under the same anchor hash. Anchors whose
   hash occurs once in the corpus are dropped; what is dropped cannot be repeated.
2. Contexts. An anchor's context is the bytes of all windows that it anchors. Equal contexts are one row from here on.
3. Induced sorting. Contexts of one hash are sorted by what follows the anchor (Spark's external sort); neighbours'
   common-prefix values are taken. From the order at an anchor the order of the suffixes one byte further left is induced:
   stably by class and preceding byte, with common-prefix values as minima over the ranges between. A suffix d bytes left
   of the anchor starts a repeated string exactly if a neighbour in its class shares length - d bytes behind the anchor.
   Blocks of groups that fit into memory are induced with numpy; a larger group goes through disk-backed priority queues
   that carry suffix tuples and common-prefix values, in bounded memory.
4. Runs of repeated starts become byte ranges of each occurrence; texts that occur twice are repeated as a whole.

digests() reports two lengths. It finds what repeats at `PASSAGE` bytes in all texts; a string of 400 bytes that occurs elsewhere
lies in such a range of 400 bytes or more, and so does its other occurrence, so the steps run again with 400 over these
ranges alone.

Every comparison that decides is one of bytes; hashes only bring candidates together (contexts and equal texts are
identified by 128-bit digests).

Defined cases: a null text is empty; texts shorter than `length` have no repeated string; repeated rows are equal texts, so
rows of `length` bytes or more lose everything; ids play no part, so they may be null or repeated; an empty table gives no
rows; other columns may have any name.
"""

from __future__ import annotations

import contextlib
import hashlib
import heapq
import itertools
import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallium.llm.common import Staged, utf8

LENGTH, K = 400, 144
#: A passage: what strings of so many bytes that occur elsewhere cover, if it has so many words.
PASSAGE, PASSAGE_WORDS = 200, 50
#: Groups of one hash with more contexts than this are induced on disk; smaller ones with numpy, about so many contexts at once.
MOST, BLOCK = 2048, 30_000
#: Bytes that one disk-backed queue keeps in memory.
ROOM = 32 << 20
#: Repeated hashes up to which a bit field of at most 2^27 bits selects anchors; more are joined.
FILTERED = 1 << 23
_TEXT = 1 << 23
_SPREAD = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 24) - 1)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def rolled(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k-byte string, from doublings of the string length."""
    part, size, have, done = _SPREAD[data], 1, None, 0
    while True:
        if k & size:
            # strings of the sizes found so far, one behind the other
            have = part if have is None else have[: len(part) - done] * _power(size) + part[done:]
            done += size
        if size * 2 > k:
            break
        part = part[:-size] * _power(size) + part[size:]
        size *= 2
    have = have[: len(data) - k + 1]
    have = have ^ (have >> np.uint64(31))
    have *= np.uint64(0xD6E8FEB86659FD93)
    return have ^ (have >> np.uint64(32))


def _least(keys: np.ndarray, window: int) -> np.ndarray:
    """The minimum of each window."""
    part, size = keys, 1
    while size * 2 <= window:
        part = np.minimum(part[:-size], part[size:])
        size *= 2
    rest = window - size
    return np.minimum(part[: len(part) - rest], part[rest:]) if rest else part


def anchors(data: bytes, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window start, last window start) of each anchor."""
    out = []
    for at in range(0, max(0, len(data) - length + 1), _TEXT):
        part = np.frombuffer(data[at : at + _TEXT + length - 1], np.uint8)
        h = rolled(part, k)
        keys = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        place = (_least(keys, length - k + 1) & _LOW).astype(np.int64)
        cut = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        p = place[cut]
        out.append((h[p].view(np.int64), p + at, cut + at, np.concatenate((cut[1:], [len(place)])) - 1 + at))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _loc(tid: bytes, place: np.ndarray) -> np.ndarray:
    """A number for a place in a text; equal for copies of the text."""
    with np.errstate(over="ignore"):
        x = (np.frombuffer(tid[:8], np.uint64)[0] ^ (place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9FB21C651E98DF25)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def _texts(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple]:
    """(tid, text, ..) once for each different text of a task."""
    seen: set[bytes] = set()
    for batch in batches:
        for x in zip(batch.column("tid").to_pylist(), utf8(batch.column("text")), *(batch.column(c).to_pylist() for c in more), strict=True):
            if x[0] not in seen:
                seen.add(x[0])
                yield x


class Bits:
    """A bit field with two places a hash."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        h = h.view(np.uint64)
        one = np.ones(len(h), np.uint64)
        for p in (h & self.mask, (h >> np.uint64(32)) & self.mask):
            one &= self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))
        return (one & np.uint64(1)) != 0


def _bits(repeated: DataFrame, n: int) -> Bits:
    """Made by a distributed aggregation; at most 2^21 words come to the driver."""
    bits = max(1 << 16, min(1 << 27, 1 << (16 * max(1, n) - 1).bit_length()))
    mask = F.lit(bits - 1).cast("long")
    place = F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 32).bitwiseAND(mask))).alias("p")
    words = repeated.select(place).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v"))
    out = np.zeros(bits // 64, np.uint64)
    table = words.toArrow()
    out[table.column("w").to_numpy()] = table.column("v").to_numpy().view(np.uint64)
    return Bits(out)


class ExternalQueue:
    """A priority queue that keeps about `room` bytes in memory; the rest lies in sorted runs in one scratch folder of its own.

    Items are tuples of numbers and bytes. FAN runs of a level are merged into one of the next, and runs are opened only while they are
    read, so a queue has at most FAN files open, however long it gets."""

    FAN = 64

    def __init__(self, room: int):
        self.room, self.items, self.held, self.levels, self.folder, self.made = room, [], 0, [], None, 0

    def push(self, item: tuple) -> None:
        self.items.append(item)
        self.held += 200 + sum(len(x) for x in item if isinstance(x, bytes))
        if self.held >= self.room:
            self.items.sort()
            self._keep(0, self.items)
            self.items, self.held = [], 0

    def _keep(self, level: int, items: Iterable[tuple]) -> None:
        self.folder = self.folder or tempfile.TemporaryDirectory(prefix="queue")
        path, self.made = f"{self.folder.name}/{self.made}", self.made + 1
        with open(path, "wb") as f:
            items = iter(items)
            while block := list(itertools.islice(items, 256)):
                pickle.dump(block, f, pickle.HIGHEST_PROTOCOL)
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) == self.FAN:
            full, self.levels[level] = self.levels[level], []
            self._keep(level + 1, heapq.merge(*map(self._read, full)))

    @staticmethod
    def _read(path: str) -> Iterator[tuple]:
        with open(path, "rb") as f, contextlib.suppress(EOFError):
            while True:
                yield from pickle.load(f)
        os.remove(path)

    def drain(self) -> Iterator[tuple]:
        """All items in order; what is read leaves the disk."""
        runs = [p for level in self.levels for p in level]  # the shortest first
        while len(runs) > self.FAN:
            self.levels = [[] for _ in self.levels]
            self._keep(len(self.levels), heapq.merge(*map(self._read, runs[: self.FAN])))
            runs = runs[self.FAN :] + self.levels[-1]
        self.items.sort()
        yield from heapq.merge(self.items, *map(self._read, runs))
        self.items, self.held, self.levels = [], 0, []
        if self.folder:
            self.folder.cleanup()
            self.folder = None


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid)
    return lo


def induce_on_disk(rows: Iterator[tuple], length: int, room: int = ROOM) -> Iterator[tuple[bytes, int, int]]:
    """rows: (ck, left, right, dmin, dmax) of one hash, by right, each ck once. Yields (ck, first d, last d) of repeated starts.
    Two queues of `room` bytes are alive; items carry what is left of their left contexts."""
    queue = ExternalQueue(room)
    last = None
    for rank, (ck, left, right, dmin, dmax) in enumerate(rows):
        queue.push((0, -1, rank, 0 if last is None else _common(last, right), ck, left[::-1], dmin, dmax, -1))
        last = right
    d = 0
    while True:
        ahead, source = ExternalQueue(room), queue.drain()
        place, item = 0, next(source, None)
        group, live, alive = 0, {}, False
        key = None
        while item is not None:
            after = next(source, None)
            cls, ch, _, lcp, ck, left, dmin, dmax, run = item
            fresh = key != (cls, ch)
            if fresh:
                key, group, live = (cls, ch), group + 1, {}
            shared = max(0 if fresh else lcp, after[3] if after is not None and (after[0], after[1]) == key else 0)
            hit = dmin <= d <= dmax and shared >= length - d and not (fresh and (after is None or (after[0], after[1]) != key))
            if hit and run < 0:
                run = d
            if not hit and run >= 0:
                yield ck, run, d - 1
                run = -1
            alone = fresh and (after is None or (after[0], after[1]) != key)
            if not fresh:
                for c in live:
                    live[c] = min(live[c], lcp)
            if d < dmax and not alone:
                c = left[0]
                ahead.push((group, c, place, live.get(c, 0), ck, left[1:], dmin, dmax, run))
                place, live[c], alive = place + 1, length, True
            elif run >= 0:
                yield ck, run, d
            item = after
        if not alive:
            return
        queue, d = ahead, d + 1


def _matrix(parts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width)


def induce(h: np.ndarray, left: list[bytes], right: list[bytes], dmin: np.ndarray, dmax: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first d, last d) of runs of repeated starts; rows by hash and right context."""
    n = len(h)
    right_m, left_m = _matrix(right, length), _matrix([x[::-1] for x in left], int(max(1, dmax.max(initial=0))))
    sizes = np.array([len(x) for x in right], np.int64)
    lcp = np.zeros(n, np.int64)
    for at in range(1, n, 4096):
        to = min(n, at + 4096)
        differ = right_m[at:to] != right_m[at - 1 : to - 1]
        first = np.where(differ.any(1), differ.argmax(1), length)
        lcp[at:to] = np.minimum(np.minimum(first, sizes[at:to]), sizes[at - 1 : to - 1])
    cls = np.cumsum(np.concatenate(([0], (h[1:] != h[:-1]).astype(np.int64))))
    row, mask, d = np.arange(n), np.zeros((n, int(dmax.max(initial=0)) + 1), bool), 0
    while len(row):
        same = np.zeros(len(row) + 1, bool)  # same[i]: row i is in the class of row i - 1
        same[1:-1] = cls[1:] == cls[:-1]
        shared = np.where(same, np.append(lcp, 0), 0)
        near = np.maximum(shared[:-1], shared[1:])
        alone = ~(same[:-1] | same[1:])
        mask[row, d] = (near >= length - d) & ~alone & (dmin[row] <= d) & (d <= dmax[row])
        go = np.flatnonzero((dmax[row] > d) & ~alone)
        if not len(go):
            break
        key = cls[go] * 256 + left_m[row[go], d]
        order = np.argsort(key, kind="stable")
        place, key = go[order], key[order]
        joined = np.concatenate(([False], key[1:] == key[:-1]))
        fresh = np.zeros(len(place), np.int64)
        at = np.flatnonzero(joined)
        if len(at):
            a, b = place[at - 1] + 1, place[at] + 1
            cuts = np.stack([a, b], 1).ravel()
            fresh[at] = np.minimum.reduceat(np.append(lcp, 0), cuts)[::2]
        row, lcp, cls = row[place], fresh, np.cumsum(~joined)
        d += 1
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    r, a = np.nonzero(edge == 1)
    _, b = np.nonzero(edge == -1)
    return r, a, b - 1


def _induced(contexts: DataFrame, length: int, most: int) -> DataFrame:
    """(ck, d1, d2) from contexts dealt by hash and sorted by right context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("h", "ck", "left", "right", "dmin", "dmax")), strict=True)

        def shown(cks, a, b):
            return pa.RecordBatch.from_arrays([pa.array(cks, pa.binary()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["ck", "d1", "d2"])

        def block(held):
            if not held:
                return
            h, ck, left, right, dmin, dmax = zip(*held, strict=True)
            r, a, b = induce(np.array(h), list(left), list(right), np.array(dmin), np.array(dmax), length)
            yield shown([ck[i] for i in r.tolist()], a, b)

        held, start, last, source = [], 0, None, rows()
        for x in source:
            if last is not None and x[1] == last[1]:
                continue  # the same context from another task
            if last is None or x[0] != last[0]:
                if len(held) >= BLOCK:
                    yield from block(held)
                    held = []
                start = len(held)
            held.append(x)
            last = x
            if len(held) - start > most:
                yield from block(held[:start])
                group, h = held[start:], x[0]
                held, start, rest = [], 0, []

                def whole(group=group, h=h, rest=rest):
                    seen = None
                    for y in group:
                        seen = y[1]
                        yield y[1:]
                    for y in source:
                        if y[0] != h:
                            rest.append(y)
                            return
                        if y[1] != seen:
                            seen = y[1]
                            yield y[1:]

                out = []
                for y in induce_on_disk(whole(), length):
                    out.append(y)
                    if len(out) >= 10_000:
                        yield shown(*zip(*out, strict=True))
                        out = []
                if out:
                    yield shown(*zip(*out, strict=True))
                held, last = list(rest), rest[0] if rest else None
        yield from block(held)

    return contexts.mapInArrow(run, "ck binary, d1 int, d2 int")


def _repeated(texts: DataFrame, length: int, k: int | None, most: int, filtered: int) -> tuple[DataFrame, list[Staged]]:
    """texts (tid, text; rows may repeat) -> (tid, start, end) of repeated bytes, unmerged, and the stored tables it reads."""
    k = k or max(1, length * K // LENGTH)
    texts = texts.where(F.octet_length("text") >= length)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = [], 0

        def batch():
            cols = [np.concatenate(x) for x in zip(*[o[:3] for o in out], strict=True)]
            tids = [t for o in out for t in [o[3]] * len(o[0])]
            return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(tids, pa.binary())], ["h", "loc", "place", "tid"])

        for t, text in _texts(batches):
            h, place, _, _ = anchors(text, length, k)
            out.append((h, _loc(t, place), place, t))
            n += len(h)
            if n > 100_000:
                yield batch()
                out, n = [], 0
        if out:
            yield batch()

    found = texts.mapInArrow(first, "h long, loc long, place long, tid binary")
    repeated = Staged(found.groupBy("h").agg(F.min("loc").alias("a"), F.max("loc").alias("b")).where("a < b").select("h"), "anchors")
    n = repeated.df.count()
    # the anchors to keep: by a bit field of bounded size, or, where there are more hashes, by their places
    bits = texts.sparkSession.sparkContext.broadcast(_bits(repeated.df, n)) if n <= filtered else None
    chosen = texts
    if bits is None:
        places = found.join(repeated.df, "h", "left_semi").groupBy("tid").agg(F.collect_set("place").alias("places"))
        chosen = texts.join(places, "tid")

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        out, size = [], 0
        names = ["h", "ck", "tid", "loc", "place", "dmin", "dmax", "left", "right"]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for x in _texts(batches, *(() if bits else ("places",))):
            t, text = x[0], x[1]
            h, place, lo, hi = anchors(text, length, k)
            keep = np.flatnonzero(bits.value.has(h) if bits else np.isin(place, np.array(x[2], np.int64)))
            for hh, loc, p, a, b in zip(*(v[keep].tolist() for v in (h, _loc(t, place), place, lo, hi)), strict=True):
                left, right = text[a:p], text[p : b + length]
                ck = hashlib.blake2b(b"%d:%d:%d:" % (hh, p - b, p - a) + left + right, digest_size=16).digest()
                new = ck not in sent
                if new:
                    if len(sent) > 1_000_000:
                        sent.clear()
                    sent.add(ck)
                out.append((hh, ck, t, loc, p, p - b, p - a, left if new else None, right if new else None))
                size += 500 + (len(left) + len(right)) * new
            if size > 1 << 23:
                yield batch()
                out, size = [], 0
        if out:
            yield batch()

    contexts_of = Staged(chosen.mapInArrow(second, "h long, ck binary, tid binary, loc long, place long, dmin int, dmax int, left binary, right binary"), "contexts")
    kept = contexts_of.df
    repeated.drop()
    contexts = kept.where(F.col("right").isNotNull()).select("h", "ck", "left", "right", "dmin", "dmax")
    runs = _induced(contexts.repartition("h").sortWithinPartitions("h", "right", "ck"), length, most)
    runs = runs.groupBy("ck").agg(F.collect_list(F.struct("d1", "d2")).alias("runs"))
    twice = kept.groupBy("ck").agg(F.min("loc").alias("a"), F.max("loc").alias("b")).where("a < b").select("ck", F.lit(True).alias("twice"))
    known = twice.join(runs, "ck", "full_outer")
    every = F.array(F.struct(F.col("dmin").alias("d1"), F.col("dmax").alias("d2")))
    spans = kept.select("ck", "tid", "place", "dmin", "dmax").join(known, "ck").select("tid", "place", F.explode(F.when(F.col("twice"), every).otherwise(F.col("runs"))).alias("r"))
    spans = spans.select("tid", (F.col("place") - F.col("r.d2")).alias("start"), (F.col("place") - F.col("r.d1") + length).alias("end"))
    return spans.distinct(), [contexts_of]


def _ranges(rows: DataFrame, length: int, k: int | None, most: int, filtered: int) -> Staged:
    """rows (tid, text) -> tid, n (rows with this text), ranges (starts and ends of repeated bytes, unmerged), for texts that
    occur twice or have ranges."""
    spans, read = _repeated(rows, length, k, most, filtered)
    # one aggregation by text: how many rows have it, and its ranges
    none = F.lit(None).cast("struct<start:bigint,end:bigint>").alias("r")
    both = rows.select("tid", F.lit(1).alias("n"), none).unionByName(spans.select("tid", F.lit(0).alias("n"), F.struct("start", "end").alias("r")))
    info = both.groupBy("tid").agg(F.sum("n").alias("n"), F.collect_list("r").alias("ranges")).where((F.col("n") > 1) | (F.size("ranges") > 0))
    out = Staged(info, "ranges")
    for x in read:
        x.drop()
    return out


def _tid(text):
    return F.unhex(F.md5(text.cast("binary"))).alias("tid")


def repeated_ranges(docs: DataFrame, length: int = LENGTH, k: int | None = None, most: int = MOST, filtered: int = FILTERED) -> DataFrame:
    """row (a struct of all columns of docs), text, tid, whole (the text occurs twice), ranges (starts and ends of repeated
    bytes, unmerged)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text.alias("text"), _tid(text))
    info = _ranges(rows.select("tid", "text"), length, k, most, filtered).df
    whole = ((F.col("n") > 1) & (F.octet_length("text") >= length)).alias("whole")
    return rows.join(info, "tid", "left").select("row", "text", "tid", whole, "ranges")


def merged(size: int, whole: bool | None, ranges: list | None) -> list[tuple[int, int]]:
    """Maximal runs of repeated bytes."""
    if whole:
        return [(0, size)]
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["start"], r["end"]) for r in ranges or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The remaining bytes."""
    kept, at = [], 0
    for a, b in runs:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def passages(data: bytes, runs: list[tuple[int, int]], least_words: int) -> list[tuple[int, int]]:
    return [(a, b) for a, b in runs if len(data[a:b].split(None, least_words)) >= least_words]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_RUNS_SQL = "array<struct<start:bigint,end:bigint>>"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), _RUNS_SQL: _RUNS}
    names = [x.split(maxsplit=1) for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, names, strict=True)], [n for n, _ in names])


def _shown(runs: list[tuple[int, int]]) -> list[dict]:
    return [{"start": a, "end": b} for a, b in runs]


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    yield from zip(*(utf8(batch.column(c)) if c == "text" else batch.column(c).to_pylist() for c in names), strict=True)


def digests(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE, least_words: int = PASSAGE_WORDS, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and removed (the byte ranges) of each row, at `length` bytes. Beside them
    n_passages, passage_bytes and passages (byte ranges): what strings of `passage` bytes that occur elsewhere cover, in
    runs of at least so many words. passage is at most length."""
    found = repeated_ranges(docs, passage, **options).select(F.col("row.doc_id").cast("long").alias("doc_id"), "text", "tid", "whole", "ranges")
    schema = f"doc_id long, tid binary, n_bytes long, whole boolean, n_passages long, passage_bytes long, passages {_RUNS_SQL}, sha string, text binary, runs {_RUNS_SQL}"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, t, tid, w, r in _rows(batch, "doc_id", "text", "tid", "whole", "ranges"):
                found = passages(t, merged(len(t), w, r), least_words)
                # of a text that occurs twice, what other texts have counts for these
                runs = [x for x in merged(len(t), False, r) if x[1] - x[0] >= length]
                out.append((i, tid, len(t), bool(w) and len(t) >= length, len(found), sum(b - a for a, b in found), _shown(found), None if runs else hashlib.sha256(t).hexdigest(), t if runs else None, _shown(runs)))
            yield _batch(out, schema)

    covered = Staged(found.mapInArrow(first, schema), "covered").df

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tid, t, runs in _rows(batch, "tid", "text", "runs"):
                out += [(tid, r["start"], t[r["start"] : r["end"]]) for r in runs]
            yield _batch(out, "of binary, first long, text binary")

    long = covered.where(F.size("runs") > 0)
    pieces = long.select("tid", "text", "runs").dropDuplicates(["tid"]).mapInArrow(cuts, "of binary, first long, text binary").select("of", "first", "text", _tid(F.col("text")))
    again = _ranges(pieces.select("tid", "text"), length, **({"k": None, "most": MOST, "filtered": FILTERED} | options)).df
    every = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("end")))
    inside = pieces.join(again, "tid").select("of", "first", F.explode(F.when(F.col("n") > 1, every).otherwise(F.col("ranges"))).alias("r"))
    inside = inside.groupBy(F.col("of").alias("tid")).agg(F.collect_list(F.struct((F.col("first") + F.col("r.start")).alias("start"), (F.col("first") + F.col("r.end")).alias("end"))).alias("ranges"))
    out_schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed {_RUNS_SQL}, n_passages long, passage_bytes long, passages {_RUNS_SQL}"

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, t, n, w, sha, r, *more in _rows(batch, "doc_id", "text", "n_bytes", "whole", "sha", "ranges", "n_passages", "passage_bytes", "passages"):
                runs = merged(n, w, r)
                kept = b"" if w else cut(t, runs)
                out.append((i, n, sum(b - a for a, b in runs), len(runs), sha if sha and not runs else hashlib.sha256(kept).hexdigest(), _shown(runs), *more))
            yield _batch(out, out_schema)

    return covered.join(inside, "tid", "left").mapInArrow(second, out_schema)


def remove(docs: DataFrame, length: int = LENGTH, least_words: int = 0, **options) -> DataFrame:
    """docs with what repeats cut out of text, in runs of at least so many words; characters that a cut divides go with it.
    Other columns stay as they are."""
    found = repeated_ranges(docs, length, **options)

    @F.pandas_udf("string")
    def rest(text, whole, ranges):
        import pandas as pd

        out = []
        for t, w, r in zip(text, whole, ranges, strict=True):
            data = t.encode()
            out.append(cut(data, passages(data, merged(len(data), bool(w), None if r is None else list(r)), least_words)).decode("utf-8", "ignore"))
        return pd.Series(out)

    touched = F.col("whole") | (F.size("ranges") > 0)
    left = F.when(touched, rest("text", F.coalesce("whole", F.lit(False)), "ranges")).otherwise(F.col("row")["text"])
    return found.withColumn("left", left).select(*(F.col("left").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
