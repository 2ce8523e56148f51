"""Language-model scores from a hidden Markov model.

Tokens are words with A-Z lowered, and one end a text. The model has a few latent states; a state emits one of a fixed number of classes
(a hash of the word), and a class emits its words in proportion to their training counts plus one, with one unseen word
a class. So log P(text) = log P(classes), by the scaled forward recursion, + the sum over tokens of
log((c + 1) / (count of the class + its distinct words + 1)), which sums to 1 over the words of the class and the unseen
one; the end is the only token of its class, with probability 1 there. The first part needs no vocabulary, the second is
a sum of counts.

Training is Baum-Welch from a random start. One pass over all training texts writes their classes, two bytes a token, and the
word counts of each task; each iteration is one distributed pass over them: tasks run forward and backward recursions over their texts side by side and
emit expected counts by class, which are summed across tasks by key. Iterations go on until the likelihood of all training
texts settles. A text of more than `segment` tokens is trained on as segments of so many tokens; all but its first start from
the states' overall shares. Scores are of whole texts.

Word counts are exact over all training texts. The most frequent words, a bounded number, are broadcast; counts of the
others reach their texts by a join.

Defined cases: a null text is empty (its only token is the end); a null id hashes as the empty text; repeated rows count
and score each; with no training text every count is 0 and scores are those of a uniform model; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallium.llm.common import Laid, Staged, utf8, with_id

STATES, CLASSES = 8, 1 << 14
#: The end of a text as a token; no word holds white space.
END = b"\n"
#: Words broadcast with their counts.
FREQUENT = 1 << 18


@dataclass(frozen=True)
class Settings:
    states: int = STATES
    #: Training ends when an iteration over all texts raises the log-likelihood by less than this share of it.
    tolerance: float = 1e-4
    segment: int = 512
    frequent: int = FREQUENT


@dataclass
class Hmm:
    """start[s], moves[s][t], emit[class][s], share[s] of all tokens; all probabilities. The end is class 0, which no word has."""

    start: np.ndarray
    moves: np.ndarray
    emit: np.ndarray
    share: np.ndarray


def class_of(word: bytes) -> int:
    return 0 if word == END else 1 + zlib.crc32(word) % (CLASSES - 1)


def fresh(states: int, seed: int = 11) -> Hmm:
    rng = np.random.default_rng(seed)
    emit = rng.gamma(1.0, 1.0, (CLASSES, states)) + 0.2
    moves = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    even = np.full(states, 1 / states)
    return Hmm(even, moves, emit / emit.sum(0), even)


def _forward(m: Hmm, laid: Laid, classes: np.ndarray, start: np.ndarray | None, keep: bool):
    """classes: in the order of laid. log P of the sequences in that order; with keep also the scaled forward vectors, the scales and the emissions of all tokens.
    start: the distribution of the first state of each sequence, where it isn't the model's."""
    kind = np.float32 if keep else np.float64
    moves, emit = m.moves.astype(kind), m.emit.astype(kind)
    total, ones = np.zeros(laid.alive[0] if len(classes) else 0), np.ones(len(moves), kind)
    alphas = np.empty((len(classes), len(moves)), kind) if keep else None
    scales, emitted = (np.empty(len(classes), kind), emit[classes]) if keep else (None, None)
    a = (np.broadcast_to(m.start, (len(total), len(moves))) if start is None else start).astype(kind)
    for t, (n, at) in enumerate(laid.steps()):
        new = alphas[at : at + n] if keep else np.empty((n, len(moves)), kind)
        if t:
            np.matmul(a[:n], moves, out=new)
        else:
            new[:] = a
        new *= emitted[at : at + n] if keep else emit[classes[at : at + n]]
        c = new @ ones
        new /= c[:, None]
        if keep:
            scales[at : at + n] = c
        else:
            total[:n] += np.log(c)
        a = new
    return (alphas, scales, emitted) if keep else total


def forward(m: Hmm, classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log P of each sequence; the sequences are laid end to end."""
    laid, out = Laid(sizes), np.zeros(len(sizes))
    out[laid.order] = _forward(m, laid, classes[laid.places], None, False)
    return out


def expected(m: Hmm, classes: np.ndarray, sizes: np.ndarray, begins: np.ndarray | None = None):
    """Sums over the sequences: of starts, of moves, of emissions by class, and log P. begins: which sequences are the
    beginning of a text (all); the others start from the states' overall shares and add nothing to the starts."""
    laid, k = Laid(sizes), len(m.start)
    classes = classes[laid.places]
    if not len(classes):
        return np.zeros(k), np.zeros((k, k)), np.zeros((CLASSES, k)), 0.0
    first = np.ones(len(sizes), bool) if begins is None else begins[laid.order]
    alphas, scales, emitted = _forward(m, laid, classes, np.where(first[: laid.alive[0], None], m.start, m.share), True)
    back, moves, b = m.moves.T.astype(np.float32).copy(), np.zeros((k, k)), None
    loglik = float(np.log(scales, dtype=np.float64).sum())
    emitted /= scales[:, None]
    for n, at in reversed(laid.steps()):
        here, e = alphas[at : at + n], emitted[at : at + n]
        if b is None:
            b = e
            continue
        live = len(b)
        moves += here[:live].T @ b
        beta = b @ back
        e[:live] *= beta
        here[:live] *= beta  # the posterior of the state, from here on
        b = e
    firsts = alphas[: laid.alive[0]][first[: laid.alive[0]]].sum(0, dtype=np.float64)
    emit = np.stack([np.bincount(classes, weights=alphas[:, s], minlength=CLASSES) for s in range(k)], 1)
    return firsts, moves * m.moves, emit, loglik


def updated(firsts: np.ndarray, moves: np.ndarray, emit: np.ndarray) -> Hmm:
    """The parameters that expected counts give, lightly smoothed: a class keeps some of its overall share in every state."""
    firsts, moves, share = firsts + 0.1, moves + 0.1, emit.sum(0) + 0.1
    overall = emit.sum(1) + 0.5
    emit = emit + 50.0 * (overall / overall.sum())[:, None]
    return Hmm(firsts / firsts.sum(), moves / moves.sum(1, keepdims=True), emit / emit.sum(0), share / share.sum())


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # of bytes, lower() changes A-Z only


def _slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of items of at most so much together, or of one."""
    at, size = 0, 0
    for i, n in enumerate(sizes):
        if size and size + n > most:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(sizes):
        yield at, len(sizes)


def _groups(batches: Iterator[pa.RecordBatch], most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Batches in slices of bounded text."""
    for batch in batches:
        for a, b in _slices([len(x) for x in utf8(batch.column("text"))], most):
            yield batch.slice(a, b - a)


class Ids(dict):
    """Numbers for words: those it starts with, then new ones as they come."""

    def __init__(self, words: Iterable[bytes] = ()):
        super().__init__((w, i) for i, w in enumerate(words))
        self.first, self.new = len(self), []

    def __missing__(self, word: bytes) -> int:
        i = self[word] = self.first + len(self.new)
        self.new.append(word)
        return i

    def forget(self) -> None:
        """Drops the new words."""
        for w in self.new:
            del self[w]
        self.new.clear()

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all tokens, ends included, and the sizes of the texts."""
        flat: list[int] = []
        sizes = []
        for t in texts:
            before = len(flat)
            flat += map(self.__getitem__, words_of(t))
            flat.append(self[END])
            sizes.append(len(flat) - before)
        return np.array(flat, np.int64), np.array(sizes, np.int64)


def _lists(words: pa.Array, n: np.ndarray, ends: list[int] | np.ndarray) -> pa.Array:
    """Lists of (w, n), cut at ends."""
    pairs = pa.StructArray.from_arrays([words, pa.array(n, pa.int64())], ["w", "n"])
    return pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pairs)


_COUNTS = "array<struct<w:binary,n:bigint>>"
_COUNTS_ARROW = pa.list_(pa.struct([("w", pa.binary()), ("n", pa.int64())]))


def classes_and_counts(rows: DataFrame) -> DataFrame:
    """tokens (the classes of a text, the end included, two bytes each) of each row; in further rows, counts of words in parts
    of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, kinds, seen = Ids(), np.zeros(0, "<u2"), np.zeros(0, np.int64)

        def out():
            for i in range(0, len(seen), 50_000):
                part = ids.new[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), _lists(pa.array(part, pa.binary()), seen[i : i + 50_000], [len(part)])], ["tokens", "counts"])

        for part in _groups(batches):
            flat, sizes = ids.of(utf8(part.column("text")))
            kinds = np.concatenate([kinds, np.array([class_of(w) for w in ids.new[len(kinds) :]], "<u2")])
            seen = np.bincount(flat, minlength=len(ids)) + np.pad(seen, (0, len(ids) - len(seen)))
            tokens, ends = kinds[flat].tobytes(), (2 * np.cumsum(sizes)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([tokens[a:b] for a, b in zip([0, *ends], ends, strict=False)], pa.binary()), pa.nulls(len(sizes), _COUNTS_ARROW)], ["tokens", "counts"])
            if len(ids) > 600_000:
                yield from out()
                ids, kinds, seen = Ids(), kinds[:0], seen[:0]
        yield from out()

    return rows.select("text").mapInArrow(run, f"tokens binary, counts {_COUNTS}")


def _segments(texts: list[bytes], segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The classes end to end, the sizes of the segments, which of these begin a text."""
    sizes, begins = [], []
    for x in texts:
        n = len(x) // 2
        whole, rest = divmod(n, segment)
        sizes += [segment] * whole + [rest] * (rest > 0)
        begins += [True] + [False] * (whole + (rest > 0) - 1)
    return np.frombuffer(b"".join(texts), "<u2"), np.array(sizes, np.int64), np.array(begins, bool)


def _iterate(tokens: DataFrame, m: Hmm, segment: int) -> tuple[Hmm, float]:
    """One Baum-Welch iteration over all rows."""
    shared, k = tokens.sparkSession.sparkContext.broadcast(m), len(m.start)
    names = [f"s{i}" for i in range(k)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        firsts, moves, emit, loglik = np.zeros(k), np.zeros((k, k)), np.zeros((CLASSES, k)), 0.0
        for batch in batches:
            texts = utf8(batch.column("tokens"))
            for a, b in _slices([len(x) for x in texts], 1_000_000):
                f, mv, e, ll = expected(model, *_segments(texts[a:b], segment))
                firsts, moves, emit, loglik = firsts + f, moves + mv, emit + e, loglik + ll
        # below the classes: the starts, the moves, the likelihood
        found = np.flatnonzero(emit.any(1))
        values = np.concatenate([emit[found], firsts[None], moves, np.full((1, k), loglik)])
        keys = np.concatenate([found, np.arange(CLASSES, CLASSES + k + 2)])
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), *(pa.array(np.ascontiguousarray(values[:, i])) for i in range(k))], ["key", *names])

    counted = tokens.mapInArrow(count, f"key int, {', '.join(f'{x} double' for x in names)}")
    got = counted.groupBy("key").agg(*(F.sum(x).alias(x) for x in names)).toArrow()  # of fixed size at most
    shared.unpersist()
    sums = np.zeros((CLASSES + k + 2, k))
    sums[got.column("key").to_numpy()] = np.stack([got.column(x).to_numpy() for x in names], 1)
    if not got.num_rows or not sums[:CLASSES].any():
        return m, 0.0
    return updated(sums[CLASSES], sums[CLASSES + 1 : CLASSES + 1 + k], sums[:CLASSES]), float(sums[-1, 0])


def train(rows: DataFrame, s: Settings = Settings()) -> tuple[Hmm, list[float], Staged]:
    """The model of the texts in rows, the log-likelihood before each iteration, and word (binary), n over all rows."""
    found, m, history = Staged(classes_and_counts(rows), "hmm-classes"), fresh(s.states), []
    counts = found.df.select(F.explode("counts").alias("c")).groupBy(F.col("c.w").alias("word")).agg(F.sum("c.n").alias("n"))
    counts = Staged(counts, "hmm-counts")
    tokens = found.df.where(F.col("tokens").isNotNull()).select("tokens")
    while len(history) < 2 or history[-1] - history[-2] > s.tolerance * abs(history[-2]):
        m, ll = _iterate(tokens, m, s.segment)
        history.append(ll)
    found.drop()
    return m, history, counts


def _frequent(counts: DataFrame, most: int) -> dict[bytes, int]:
    """The most frequent words with their counts, so many at most: those above the least count, by steps of an eighth of a
    power of two, that few enough words reach."""
    step = F.floor(F.log2("n") * 8).cast("int")
    total, least = 0, None
    for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect():
        total += r["words"]
        if total > most:
            break
        least = r["step"]
    if least is None:
        return {}
    found = counts.where(step >= least).toArrow()
    return dict(zip(found.column("word").to_pylist(), found.column("n").to_pylist(), strict=True))


def score(docs: DataFrame, held_out, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    spark = docs.sparkSession
    rows = with_id(docs, held_out.alias("held_out"))
    training = rows.where(~F.col("held_out"))
    model, _, stored = train(training, s)
    counts = stored.df
    # in each class the weights c + 1 of its words, but for the unseen one; the end has no unseen word beside it
    is_end = F.col("word") == F.lit(bytearray(END))
    kind = F.when(is_end, 0).otherwise(F.crc32("word") % (CLASSES - 1) + 1).cast("int").alias("kind")
    sums = counts.groupBy(kind).agg(F.sum(F.col("n") + F.when(is_end, 0).otherwise(1)).alias("weight"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).toArrow()
    of_class = np.zeros(CLASSES)
    of_class[sums.column("kind").to_numpy()] = sums.column("weight").to_numpy()
    n_all, n_kinds = (int(np.sum(sums.column(c).to_numpy())) if sums.num_rows else 0 for c in ("n", "kinds"))
    top = _frequent(counts, s.frequent)
    shared = spark.sparkContext.broadcast((model, top, of_class))
    least = math.log10(n_all + 1 * (n_kinds + 1))
    whole = len(top) == n_kinds  # no word is left for the join

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, frequent, by_class = shared.value
        log_class = np.log10(by_class + 1)
        ids, n = Ids(frequent), len(frequent)
        logs, kinds = np.log10(np.array(list(frequent.values()), float) + 1), np.array([class_of(w) for w in frequent], np.int64)
        for part in _groups(batches):
            flat, sizes = ids.of(utf8(part.column("text")))
            starts, new = np.cumsum(sizes) - sizes, ids.new
            laid = np.concatenate([kinds, np.array([class_of(w) for w in new], np.int64)])[flat]
            hidden = forward(m, laid, sizes) / math.log(10) - np.add.reduceat(log_class[laid], starts)
            sums, known = np.add.reduceat(np.append(logs, np.zeros(len(new)))[flat], starts), np.add.reduceat((flat < n).astype(np.int64), starts)
            # the words that are not in the table, with their numbers in each text
            other = np.flatnonzero(flat >= n) if not whole else np.zeros(0, np.int64)
            owner = np.searchsorted(starts, other, side="right") - 1
            pairs, times = np.unique(owner * (len(new) + 1) + flat[other] - n, return_counts=True)
            owner, word = np.divmod(pairs, len(new) + 1)
            rare = _lists(pa.array(new, pa.binary()).take(pa.array(word, pa.int64())), times, np.searchsorted(owner, np.arange(len(sizes)), side="right").tolist())
            ids.forget()
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(sizes), pa.array(known), pa.array(sums), pa.array(hidden), rare],
                ["doc_id", "held_out", "n_tokens", "known", "sums", "hidden", "rare"],
            )

    found = rows.mapInArrow(run, f"doc_id long, held_out boolean, n_tokens long, known long, sums double, hidden double, rare {_COUNTS}")
    if not whole:
        found = Staged(found.withColumn("row", F.monotonically_increasing_id()), "hmm-rows").df
        asked = found.select("row", F.explode("rare").alias("r")).select("row", F.col("r.w").alias("word"), F.col("r.n").alias("times"))
        more = asked.join(counts, "word").groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_sums"))
        found = found.drop("rare").join(more, "row", "left")
        found = found.withColumn("known", F.col("known") + F.coalesce("more_known", F.lit(0))).withColumn("sums", F.col("sums") + F.coalesce("more_sums", F.lit(0.0)))
    return found.select(
        "doc_id", "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("sums") - F.col("n_tokens") * F.lit(least)).alias("base_score"), (F.col("sums") + F.col("hidden")).alias("score"),
    )


def fold(of: int, is_: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % of == is_
