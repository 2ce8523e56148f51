"""Token counts by a compiled finite-state transducer.

A sentencepiece BPE model is compiled, as texts need it, into a deterministic transducer: a state is what the coming
characters can still depend on, a transition is annotated with the number of tokens that it adds (it may be negative,
when a character lets earlier tokens melt into one). The count of a text is the sum of its transitions.

Why this is exact: in BPE the last token of every prefix is the longest vocabulary suffix that, encoded together with
the last token of the prefix before it, stays apart from it. So the count of a prefix is one more than that of a
shorter prefix, and only as many last tokens have to be remembered as the longest piece still open is long.

Two characters that stand together in no piece synchronise: behind the first the state is the start state, whatever
came before. The change from a non-space to a space is such a place. Spaces become U+2581 before anything is cut, as the model has it, so
that a U+2581 in a text is a space too. A chunk of a text therefore maps an unknown entry state to (head still to be run from that
state, fixed count, exit state); such maps compose associatively. Every text is cut into chunks whose maps the up-sweep of a parallel prefix
scan joins; only the total is asked for, so there is no down-sweep. Units between
synchronising places repeat, so their sums are kept as macro transitions.

Defined cases: a null text is empty and has 0 tokens; repeated rows give equal rows; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallium.llm.common import Memo, with_id

SPACE = "▁"
CHUNK = 1 << 12
#: Units longer than this run through the transducer each time instead of being kept.
LONG_UNIT = 48
MAX_STATES = 200_000
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_SYNC = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")


class Vocabulary:
    """Pieces, their scores, and BPE merging as sentencepiece defines it: the best-scored pair first, leftmost among equals."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score = {}
        for i in range(model.vocab_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                self.score[model.id_to_piece(i)] = model.get_score(i)
        self.prefixes = {p[:k] for p in self.score for k in range(1, len(p) + 1)}
        self.bonds = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.apart = Memo(lambda ab: self.merge(ab[0] + ab[1]) == [ab[0], ab[1]])
        self.whole = Memo(lambda a: self.merge(a) == [a])

    def cost(self, token: str) -> int:
        """A character without a piece becomes its UTF-8 bytes."""
        return 1 if token in self.score else len(token.encode())

    def merge(self, text: str) -> list[str]:
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts


@dataclass
class ChunkMap:
    """What a chunk does to any entry state. exit is None when the chunk holds no synchronising place."""

    head: str
    count: int
    exit: int | None


class Transducer:
    """States are tuples (open text, last tokens, counts relative to the newest); both tuples have one entry more than the open text has characters."""

    START = 0

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.reset()
        self.part = Memo(lambda p: self.run(self.START, p)[1])
        self.unit = Memo(self._unit)

    def reset(self) -> None:
        self.states, self.index, self.next = [("", ("",), (0,))], {("", ("",), (0,)): 0}, [{}]

    def _compile(self, state: int, ch: str) -> tuple[int, int]:
        v, (text, lasts, counts) = self.v, self.states[state]
        text += ch
        found = None
        for size in range(len(text), 0, -1):
            token = text[-size:]
            if size > 1 and token not in v.score:
                continue
            before = lasts[-size]
            if v.apart[before, token] if before else v.whole[token]:
                found = (token, counts[-size] + v.cost(token))
                break
        if found is None:  # cannot happen while the theorem in the head holds; a lone character is always whole
            found = (ch, counts[-1] + v.cost(ch))
        lasts, counts = (*lasts, found[0]), (*counts, found[1])
        keep = len(text)
        while keep and text[-keep:] not in v.prefixes:
            keep -= 1
        new = (text[len(text) - keep :], lasts[-keep - 1 :], tuple(c - found[1] for c in counts[-keep - 1 :]))
        to = self.index.get(new)
        if to is None:
            to = self.index[new] = len(self.states)
            self.states.append(new)
            self.next.append({})
        self.next[state][ch] = (to, found[1])
        return to, found[1]

    def _unit(self, unit: str) -> int:
        """A macro transition: the sum over the unit's parts between synchronising places."""
        bonds, total, at = self.v.bonds, 0, 0
        for i in range(1, len(unit)):
            if unit[i - 1 : i + 1] not in bonds:
                total += self.part[unit[at:i]]
                at = i
        return total + self.part[unit[at:]]

    def run(self, state: int, text: str) -> tuple[int, int]:
        total, tables = 0, self.next
        for ch in text:
            step = tables[state].get(ch)
            state, delta = step if step is not None else self._compile(state, ch)
            total += delta
        return state, total

    def chunk(self, text: str) -> ChunkMap:
        sync = _SYNC.search(text)
        if sync is None:
            return ChunkMap(text, 0, None)
        units = _UNIT.findall(text, sync.start())
        unit = self.unit
        count = sum(unit[u] if len(u) <= LONG_UNIT else self.run(self.START, u)[1] for u in units[:-1])
        state, last = self.run(self.START, units[-1])
        return ChunkMap(text[: sync.start()], count + last, state)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        if a.exit is None:
            joined = a.head + b.head
            sync = _SYNC.search(joined)
            if sync is not None:  # the place between the two chunks may be one itself
                first = self.chunk(joined)
                return first if b.exit is None else ChunkMap(first.head, first.count + b.count, b.exit)
            return ChunkMap(joined, b.count, b.exit)
        state, count = self.run(a.exit, b.head)
        return ChunkMap(a.head, a.count + count + b.count, state if b.exit is None else b.exit)

    def total(self, maps: list[ChunkMap]) -> ChunkMap:
        """All maps composed: the up-sweep of a parallel prefix scan, in log2(n) rounds of independent compositions."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def count(self, text: str, chunk: int = CHUNK) -> int:
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)  # with the model's dummy prefix
        whole = self.total([self.chunk(text[i : i + chunk]) for i in range(0, len(text), chunk)])
        return self.run(self.START, whole.head)[1] + whole.count

    def trim(self) -> None:
        self.unit.trim()
        self.part.trim()
        self.v.apart.trim()
        if len(self.states) > MAX_STATES:
            self.reset()


_COMPILED: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One per worker process and model."""
    if path not in _COMPILED:
        _COMPILED[path] = Transducer(Vocabulary(path))
    return _COMPILED[path]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model_path)
        for batch in batches:
            counts, since = [], 0
            for x in batch.column("text").to_pylist():
                counts.append(t.count(x, chunk) if x else 0)
                since += len(x or "")
                if since > 1 << 22:
                    t.trim()
                    since = 0
            t.trim()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    sized = with_id(docs).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return sized.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
