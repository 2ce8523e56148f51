"""Best-fit packing with swap-based local search.

Documents are tokenized where they lie; only (document, piece, length) digests move. All that packing has to know is how
many pieces of each length there are, at most one number for each length up to the capacity, so the plan is made on the
driver whatever the size of the corpus: best fit over lengths in falling order, whole runs of equal bins at a time. Then
underfull bins exchange one piece for one, two for one, or move one, whenever the sum of squared fills rises, until bins
empty or the least possible number of bins is reached. Bins of equal content are one entry with a multiplicity.

A plan line says: of the pieces of this length, those with ranks from..to lie in sequences base, base+1, .. at this
offset. Ranks are per length, from counts of (input part, length) and places within the part; no length, however
frequent, has to pass through one task.

Defined cases: a null text is empty and has only the end id; repeated rows are packed each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallium.llm.common import Staged, utf8, with_id

CAPACITY = 4096
END_ID = 1


#: ASCII lower-case letters and the composed letters of Latin-1, as UTF-8.
_LETTER = rb"[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]"
_PLAIN = re.compile(rb"(?:" + _LETTER + rb")+")
_SMALL, _TAIL, _MARK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SMALL[list(range(0x61, 0x7B))] = True
_TAIL[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
_MARK[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True


class WordTokenizer:
    """Ids of whole texts. The tokenizer never looks across ASCII white space, nor from a letter to the punctuation behind it,
    and it lowers case; so texts are cut into plain forms, and each form is encoded once and kept, in two generations of
    bounded size. A text with the opening of a special string is cut at white space only. Forms of letters alone are encoded
    many at a time and told apart by the word ends of the vocabulary; where their number differs, one by one."""

    def __init__(self, path: str, most: int = 250_000, joined: int = 100):
        from tokenizers import Tokenizer

        self.model, self.most, self.joined = Tokenizer.from_file(path), most, joined
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.ends = np.zeros(self.model.get_vocab_size(), bool)
        self.ends[[i for t, i in self.model.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True

    @staticmethod
    def forms(texts: list[bytes]) -> list[list[bytes]]:
        """The forms of each text. A blank goes between a letter and the ASCII punctuation behind it."""
        whole = np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8)
        if not len(whole):
            return []
        letter = _SMALL[whole]
        letter[1:] |= _TAIL[whole[1:]] & (whole[:-1] == 0xC3)
        seams = np.flatnonzero(letter[:-1] & _MARK[whole[1:]]) + 1
        ends = np.cumsum([len(t) + 1 for t in texts])
        ends += np.searchsorted(seams, ends)
        wide, out, at = np.insert(whole, seams, 32).tobytes(), [], 0
        for text, end in zip(texts, ends.tolist(), strict=True):
            out.append(text.split() if b"<|" in text else wide[at:end].split())
            at = end
        return out

    def _encode(self, texts: list[str]) -> list:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _one_by_one(self, forms: list[bytes]) -> None:
        for i in range(0, len(forms), 1000):
            part = forms[i : i + 1000]
            for form, ids in zip(part, self._encode([f.decode() for f in part]), strict=True):
                self.known[form] = np.array(ids, "<u4").tobytes()

    def learn(self, texts: list[list[bytes]]) -> None:
        """Encodes the forms that are not known yet."""
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        plain, other = [], []
        for form in set().union(*texts).difference(self.known):
            have = self.older.get(form)
            if have is not None:
                self.known[form] = have
            else:
                (plain if _PLAIN.fullmatch(form) else other).append(form)
        for i in range(0, len(plain), self.joined):
            part = plain[i : i + self.joined]
            ids = np.array(self._encode([b" ".join(part).decode()])[0], "<u4")
            last = np.flatnonzero(self.ends[ids])
            if len(last) != len(part):
                other.extend(part)
                continue
            raw, at = ids.tobytes(), 0
            for form, end in zip(part, ((last + 1) * 4).tolist(), strict=True):
                self.known[form] = raw[at:end]
                at = end
        self._one_by_one(other)

    def ids(self, forms: list[bytes]) -> bytes:
        return b"".join(map(self.known.__getitem__, forms))


_TOKENIZERS: dict[str, WordTokenizer] = {}
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece; place numbers the pieces of one length within an input part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        tokenizer = _TOKENIZERS.setdefault(tokenizer_path, None) or WordTokenizer(tokenizer_path)
        _TOKENIZERS[tokenizer_path] = tokenizer
        part, seen, end = TaskContext.get().partitionId(), Counter(), np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = tokenizer.forms(utf8(batch.column("text")))
                tokenizer.learn(texts)
                out = []
                for doc_id, forms in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                    ids = tokenizer.ids(forms) + end
                    n = len(ids) // 4
                    for k, start in enumerate(range(0, n, capacity)):
                        length = min(capacity, n - start)
                        out.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, seen[length]))
                        seen[length] += 1
                cols = list(zip(*out, strict=True)) if out else [()] * 7
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return with_id(docs).mapInArrow(run, PIECES)


def best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Bins as {content (falling tuple of lengths): how many}, by best fit over falling lengths."""
    bins: dict[int, Counter] = defaultdict(Counter)  # free room -> contents
    rooms: list[int] = []  # the rooms in use, rising

    def put(content: tuple, free: int, n: int) -> None:
        if free not in bins or not bins[free]:
            insort(rooms, free)
        bins[free][content] += n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                free = rooms[i]
                content, n = next(iter(bins[free].items()))
                k = min(1, free // length) and min(n, left)
                if k == n:
                    del bins[free][content]
                    if not bins[free]:
                        rooms.pop(i)
                else:
                    bins[free][content] -= k
                put((*content, length), free - length, k)
                left -= k
            else:
                each = capacity // length
                n, rest = divmod(left, each)
                if n:
                    put((length,) * each, capacity - each * length, n)
                if rest:
                    put((length,) * rest, capacity - rest * length, 1)
                left = 0
    out: Counter = Counter()
    for contents in bins.values():
        out.update(contents)
    return out


def improve(bins: Counter, capacity: int) -> Counter:
    """Local search among the underfull bins; keeps every piece, never adds a bin.

    The emptiest bins give pieces away: to the other underfull bins, fullest first, they move a piece, or exchange one of
    their pieces for a shorter one, or two for one, if that raises the sum of squared fills. Such a step makes the fuller
    bin fuller, and is done for as many bins of these contents as there are; it ends when the least number of bins is
    reached or no step helps."""
    bins = Counter({b: n for b, n in bins.items() if n})
    number, least = sum(bins.values()), -(-sum(sum(b) * n for b, n in bins.items()) // capacity)

    def step_of(giver: tuple, takers: list[tuple]) -> tuple | None:
        """The best step to the fullest taker that has one."""
        have, fill_g = Counter(giver), sum(giver)
        gives = sorted(have, reverse=True)
        pairs = [(x, y) for i, x in enumerate(gives) for y in gives[i:] if x != y or have[x] > 1]
        for taker in takers:
            fill_t = sum(taker)
            free, best = capacity - fill_t, None
            # a step moves d with max(0, fill_g - fill_t) < d <= free
            if free <= fill_g - fill_t or (taker == giver and bins[giver] < 2):
                continue
            backs = set(taker)
            options = [((x,), ()) for x in gives if x <= free]
            options += [((x,), (y,)) for x in gives for y in backs if y < x <= free + y]
            options += [((x, y), (z,)) for x, y in pairs for z in backs if z < x + y <= free + z]
            for out, back in options:
                d = sum(out) - sum(back)
                gain = (fill_t + d) ** 2 + (fill_g - d) ** 2 - fill_t**2 - fill_g**2
                if gain > 0 and (best is None or gain > best[0]):
                    best = (gain, taker, out, back)
            if best:
                return best
        return None

    def underfull() -> list[tuple]:
        return sorted((b for b in bins if sum(b) < capacity), key=lambda b: (-sum(b), b))

    helped = True
    while helped and number > least:
        helped = False
        takers = underfull()
        for giver in reversed(takers):
            while bins[giver] and number > least and (step := step_of(giver, takers)):
                _, taker, out, back = step
                n = bins[giver] // 2 if taker == giver else min(bins[giver], bins[taker])
                for content, lose, win in ((giver, out, back), (taker, back, out)):
                    rest = list(content)
                    for x in lose:
                        rest.remove(x)
                    new = tuple(sorted([*rest, *win], reverse=True))
                    bins[content] -= n
                    if new:
                        bins[new] += n
                    else:
                        number -= n
                for content in {giver, taker}:
                    if not bins[content]:
                        del bins[content]
                helped, takers = True, underfull()
    return bins


def plan_lines(bins: Counter) -> np.ndarray:
    """Lines (length, first rank, number, first sequence, offset), by length and rank."""
    lines, used, sequence = [], Counter(), 0
    for content, n in sorted(bins.items()):
        offset = 0
        for length in content:
            lines.append((length, used[length], n, sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return np.array(sorted(lines), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row."""
    spark = docs.sparkSession
    found = Staged(pieces(docs, tokenizer_path, capacity, end_id), "pieces").df
    tally = found.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = tally.select("part", "length", F.coalesce(before, F.lit(0)).alias("first"))
    # one number for each length, capacity rows at most
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    lines = plan_lines(improve(best_fit(counts, capacity), capacity))
    plan = spark.sparkContext.broadcast(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = plan.value
        wide = np.int64(1) << 42
        keys = lines[:, 0] * wide + lines[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length * wide + rank, side="right") - 1
            sequence, offset = lines[at, 3] + rank - lines[at, 1], lines[at, 4]
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = found.join(firsts, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
