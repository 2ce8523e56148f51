"""Toxic spans by a linear-chain conditional random field.

Labels are given for documents, the field needs them for tokens. They are derived in two steps. First, over all
sampled training texts (equal texts count once), document frequencies of words, word heads and word tails are counted on
either side; a feature that is far more frequent in toxic texts than chance allows marks the tokens that have it. Then the
field (states clean, toxic) is fitted to the token labels of a bounded sample of these texts by gradient ascent on the
conditional log-likelihood. Its features are the word, heads and tails of it, hashed; so inflected forms
that were never seen share what was learned of their stem.

Scoring runs forward and backward recursions over each whole text, all texts of a batch side by side. A document's
score is a logistic function of its marginals (the greatest, the expected number of toxic tokens, their share), fitted on the
labelled sample; tokens with a marginal of one half or more are reported with their offsets.

Defined cases: a null text is empty and scores as a text without toxic tokens; null labels are not learned from; a
document with conflicting labels counts as toxic; without any learnable label every score is the training share of toxic
texts (one half when there is none); repeated rows score alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallium.llm.common import Laid, Memo, Staged, utf8, with_id

BUCKETS = 1 << 17
WIDTH = 9  # the most features of a word
BLOCK = 100_000  # tokens that the fit looks at side by side
_LETTERS = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Settings:
    """The bounds of what is learned from. labelled_toxic and labelled_clean: about so many labelled training documents, those
    of the lowest hashes of their ids, are read for the lexicon (all, if there are fewer). sample_toxic and sample_clean: so
    many of their texts of up to `longest` characters, chosen by a hash of the text, are fitted on, the field on segments of so many
    tokens, the document score on whole texts; so what comes to the driver is bounded. Longer labelled texts count in the lexicon."""

    labelled_toxic: int = 10_000
    labelled_clean: int = 20_000
    sample_toxic: int = 2000
    sample_clean: int = 2000
    longest: int = 20_000
    least_texts: int = 4
    epochs: int = 45
    segment: int = 100


def features(word: str) -> list[str]:
    """Of a lower-case run of letters."""
    out = [f"w:{word}"]
    out += [f"h:{word[:k]}" for k in (3, 4, 5, 6, 7) if len(word) > k]
    out += [f"t:{word[-k:]}" for k in (3, 4, 5) if len(word) > k]
    return out


def letters(token: bytes) -> str:
    word = token.decode()
    return (word if word.isalpha() else "".join(_LETTERS.findall(word))).lower()


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


@dataclass
class Model:
    """unary: log-odds of toxic for each hashed feature; moves[a][b]: score of state b after state a; doc: weights of the document score."""

    unary: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))
    bias: float = -6.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    doc: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def odds(self) -> Memo:
        """The log-odds of a token on its own."""
        weights, bias = self.unary.tolist(), self.bias

        def of(token: bytes) -> float:
            word = letters(token)
            return bias + sum([weights[bucket(f)] for f in features(word)]) if word else bias

        return Memo(of)


def _recursions(odds: np.ndarray, laid: Laid, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In the order of laid: the odds of each token on its own, those with all that stands before it, and the factor that what
    stands behind it adds. A step takes odds r to (a r + b) / (c r + d), which lies between b / d and a / c, so nothing grows along
    a sequence."""
    own = np.exp(np.clip(odds[laid.places], -300, 300))
    (d, b), (c, a) = np.exp(moves)
    before, behind, steps = own.copy(), np.ones(len(own)), laid.steps()
    for (_, last), (n, at) in zip(steps, steps[1:], strict=False):
        r = before[last : last + n]
        before[at : at + n] *= (a * r + b) / (c * r + d)
    for (n, at), (_, last) in zip(steps[:0:-1], steps[-2::-1], strict=True):
        r = own[at : at + n] * behind[at : at + n]
        behind[last : last + n] = (a * r + c) / (b * r + d)
    return own, before, behind


def marginals(odds: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """P(toxic) of every token of several sequences laid end to end, by the forward and backward recursions."""
    laid, out = Laid(sizes), np.empty(len(odds))
    _, before, behind = _recursions(odds, laid, moves)
    with np.errstate(over="ignore"):
        both = before * behind
        out[laid.places] = both / (1 + both)
    out[np.isnan(out)] = 1.0  # infinite odds
    return out


def _pairs(odds: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Expected transitions, as a 2x2 matrix (for training)."""
    laid = Laid(sizes)
    own, before, behind = _recursions(odds, laid, moves)
    steps, m, out = laid.steps(), np.exp(moves), np.zeros((2, 2))
    for (_, last), (n, at) in zip(steps, steps[1:], strict=False):
        f, b = before[last : last + n], own[at : at + n] * behind[at : at + n]
        s = np.stack([np.full(n, m[0, 0]), m[0, 1] * b, m[1, 0] * f, m[1, 1] * f * b])
        out += (s / s.sum(0)).sum(1).reshape(2, 2)
    return out


def document_features(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(1, greatest marginal, log of one plus the expected number, share) of each sequence. Number and share are of tokens more
    likely toxic than not, so that the many small marginals of a very long text do not add up."""
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    out = np.zeros((len(sizes), 4))
    out[:, 0] = 1
    on = sizes > 0
    if on.any():
        sums = np.add.reduceat(np.where(p >= 0.5, p, 0.0), starts[on])
        out[on, 1] = np.maximum.reduceat(p, starts[on])
        out[on, 2] = np.log1p(sums)
        out[on, 3] = sums / sizes[on]
    return out


def _labelled(docs: DataFrame, labels: DataFrame, held_out, s: Settings) -> tuple[Staged, dict[int, int]]:
    """key, toxic, text of each different text among the sampled documents; how many labelled training documents there are of
    either kind. Ids meet labels first, so that no text but those of the sample moves."""
    y = labels.where(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    rows = with_id(docs, held_out.alias("held_out")).where("not held_out and length(text) > 0")
    ids = Staged(rows.select("doc_id").distinct().join(y.hint("merge"), "doc_id"), "toxic-ids")
    total = {r["toxic"]: r["n"] for r in ids.df.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    # a hash below a share of the range of hashes
    below = {t: int(-(2.0**63) + 2.0**64 * min(1.0, most / max(1, total.get(t, 0)))) for t, most in ((1, s.labelled_toxic), (0, s.labelled_clean))}
    below = {t: min(x, (1 << 63) - 1) for t, x in below.items()}
    chosen = ids.df.where(F.xxhash64("doc_id") <= F.when(F.col("toxic") == 1, below[1]).otherwise(below[0]).cast("long"))
    texts = rows.join(F.broadcast(chosen), "doc_id")  # of bounded size
    sample = Staged(texts.groupBy(F.md5(F.col("text").cast("binary")).alias("key")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")), "toxic-sample")
    ids.drop()
    return sample, total


def lexicon(rows: DataFrame, s: Settings, clean_weight: float = 1.0) -> list[str]:
    """Features that mark toxic tokens, from the document frequencies over all rows (text, toxic). A clean row stands for
    clean_weight rows."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Memo(lambda t: features(letters(t)) if letters(t) else [])
        pos, neg = Counter(), Counter()

        def out():
            keys = list(pos.keys() | neg.keys())
            for i in range(0, len(keys), 100_000):
                k = keys[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array([pos[x] for x in k], pa.int64()), pa.array([neg[x] for x in k], pa.int64())], ["feature", "pos", "neg"])

        for batch in batches:
            for text, y in zip(utf8(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
                (pos if y else neg).update({f for t in set(text.split()) for f in of[t]})
                if len(pos) + len(neg) > 600_000:
                    yield from out()
                    pos.clear()
                    neg.clear()
            of.trim()
        yield from out()

    schema = "feature string, pos long, neg long"
    total = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = sum(n for y, n in total.items() if y), total.get(0, 0) * clean_weight
    if not n_pos or not n_neg:
        return []
    both = rows.mapInArrow(counted, schema).groupBy("feature").agg(F.sum("pos").alias("pos"), (F.sum("neg") * F.lit(float(clean_weight))).alias("neg")).where(F.col("pos") >= s.least_texts)
    # the lower end of a Wilson interval of the share of toxic texts among those with the feature
    n, z = F.col("pos") + F.col("neg"), 2.5
    share = F.col("pos") / n
    low = (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    prior = n_pos / (n_pos + n_neg)
    least = min(0.9, max(3 * prior, 0.5 if prior < 0.3 else (1 + prior) / 2))
    best = both.withColumn("low", low).where((F.col("low") > least * 0.7) & (share > max(0.8, least)))
    return [r["feature"] for r in best.orderBy(F.desc("low"), F.desc("pos"), "feature").collect()]


def _blocks(sequences: list[tuple[np.ndarray, int]], most: int) -> Iterator[list[tuple[np.ndarray, int]]]:
    """Runs of sequences of about so many tokens, so that what a pass holds at once is bounded."""
    part, held = [], 0
    for x in sequences:
        part.append(x)
        held += len(x[0])
        if held >= most:
            yield part
            part, held = [], 0
    if part:
        yield part


def fit(texts: list[tuple[bytes, int]], marks: list[str], s: Settings, prior: float) -> Model:
    """The field on token labels, then the document score on text labels. prior: the share of toxic texts before sampling."""
    model, known = Model(), set(marks)
    vocabulary: dict[bytes, int] = {}
    marked, flat = bytearray(), array("i")  # of each word: has it a mark; its buckets, filled up to WIDTH
    sequences, text_y = [], []
    for text, toxic in texts:
        words = text.split()
        if not words:
            continue
        for w in words:
            if w not in vocabulary:
                vocabulary[w] = len(vocabulary)
                word = letters(w)
                fs = features(word) if word else []
                flat.extend([bucket(f) for f in fs] + [BUCKETS] * (WIDTH - len(fs)))
                marked.append(any(f in known for f in fs))
        sequences.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
        text_y.append(1 if toxic else 0)
    if not sequences:
        model.doc[0] = math.log((prior + 1e-6) / (1 - prior + 1e-6)) if 0 < prior < 1 else 0.0
        return model
    label = np.frombuffer(marked, np.uint8)
    columns = np.ascontiguousarray(np.frombuffer(flat, np.int32).reshape(-1, WIDTH).T)
    del vocabulary, flat

    def summed(w):
        out = np.zeros(columns.shape[1])
        for column in columns:
            out += w[column]
        return out

    # a toxic text in which nothing is marked says nothing about its tokens
    cut = [(x[i : i + s.segment], toxic) for toxic, x in zip(text_y, sequences, strict=True) if not toxic or label[x].any() for i in range(0, len(x), s.segment)]
    blocks = [(np.concatenate([x for x, _ in part]), np.array([len(x) for x, _ in part], np.int64)) for part in _blocks(cut, BLOCK)]
    marks_in = [np.concatenate([label[x] * np.uint8(toxic) for x, toxic in part]) for part in _blocks(cut, BLOCK)]
    total = sum(int(y.sum()) for y in marks_in)
    if total:
        seen = np.zeros((2, 2))
        yv = np.zeros(len(label))
        for (ids, sizes), y in zip(blocks, marks_in, strict=True):
            first = np.zeros(len(ids), bool)
            first[np.cumsum(sizes)[:-1]] = True
            first[0] = True
            right = np.flatnonzero(~first)
            seen += np.bincount(2 * y[right - 1] + y[right], minlength=4).reshape(2, 2)
            yv += np.bincount(ids, weights=y, minlength=len(label))
        del cut, marks_in
        w, grad2, moves2, bias2 = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-8), np.full((2, 2), 1e-8), 1e-8
        for epoch in range(s.epochs):
            w[BUCKETS] = 0
            of_word = model.bias + summed(w)
            error, gb, met = yv.copy(), float(total), np.zeros((2, 2))
            for ids, sizes in blocks:
                odds = of_word[ids]
                p = marginals(odds, sizes, model.moves)
                error -= np.bincount(ids, weights=p, minlength=len(label))
                gb -= float(p.sum())
                if epoch % 3 == 0:
                    met += _pairs(odds, sizes, model.moves)
            g = np.zeros(BUCKETS + 1)
            for column in columns:
                g += np.bincount(column, weights=error, minlength=BUCKETS + 1)
            g -= 0.05 * w
            grad2 += g * g
            w += 0.5 * g / np.sqrt(grad2)
            bias2 += gb * gb
            model.bias += 0.5 * gb / math.sqrt(bias2)
            if epoch % 3 == 0:
                gm = seen - met - 0.5 * model.moves
                moves2 += gm * gm
                model.moves = model.moves + 0.2 * gm / np.sqrt(moves2)
        model.unary = w[:BUCKETS].copy()
    of_word = model.bias + summed(np.append(model.unary, 0.0))
    parts = []
    for part in _blocks([(x, 0) for x in sequences], BLOCK):
        sizes = np.array([len(x) for x, _ in part], np.int64)
        parts.append(document_features(marginals(of_word[np.concatenate([x for x, _ in part])], sizes, model.moves), sizes))
    x = np.concatenate(parts)
    ty = np.array(text_y, float)
    share = ty.mean()
    weight = np.where(ty > 0, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9))
    for _ in range(50):  # Newton steps of a weighted, ridged logistic regression
        q = 1 / (1 + np.exp(-np.clip(x @ model.doc, -30, 30)))
        step = x.T @ (weight * (ty - q)) - 0.01 * model.doc
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + 0.01 * np.eye(4)
        model.doc = model.doc + np.linalg.solve(h, step)
        if np.abs(step).max() < 1e-6:
            break
    return model


def train(docs: DataFrame, labels: DataFrame, held_out, s: Settings = Settings()) -> Model:
    """held_out: a boolean column over docs; its rows are never learned from."""
    stored, total = _labelled(docs, labels, held_out, s)
    rows = stored.df
    read = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {t: min(1.0, most / max(1, total.get(t, 0))) for t, most in ((1, s.labelled_toxic), (0, s.labelled_clean))}
    weight = share[1] / share[0]
    marks = lexicon(rows, s, weight)
    sample = []
    for toxic, most in ((1, s.sample_toxic), (0, s.sample_clean)):
        part = rows.where((F.col("toxic") == toxic) & (F.length("text") <= s.longest))
        keys = [r["key"] for r in part.select("key").orderBy("key").limit(most).collect()]
        if keys:
            sample += [(r["text"].encode(), toxic) for r in part.where(F.col("key") <= keys[-1]).orderBy("key").select("text").collect()]
    stored.drop()
    n = read.get(1, 0) + read.get(0, 0) * weight
    return fit(sample, marks, s, read.get(1, 0) / n if n else 0.5)


def _whole(batches: Iterator[pa.RecordBatch], m: Model) -> Iterator[tuple]:
    """(batch, sizes, marginals, document scores as log-odds) of parts of batches."""
    odds_of = m.odds()
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            batch = whole.slice(at, 2000)
            words = [t.split() for t in utf8(batch.column("text"))]
            sizes = np.array([len(x) for x in words], np.int64)
            flat: list[float] = []
            for x in words:
                flat += map(odds_of.__getitem__, x)
            p = marginals(np.array(flat), sizes, m.moves)
            yield batch, sizes, p, document_features(p, sizes) @ m.doc
            odds_of.trim()


SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_toxic long, spans array<struct<start:long,end:long,p:double>>"


def score(docs: DataFrame, model: Model, held_out) -> DataFrame:
    """doc_id, held_out, score, predicted, the number of toxic tokens and their code-point offsets with marginals."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sizes, p, odds in _whole(batches, shared.value):
            scores = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            hits = np.flatnonzero(p >= 0.5)
            ends = np.cumsum(sizes)
            owner = np.searchsorted(ends, hits, side="right")
            spans: list[list] = [[] for _ in sizes]
            texts = batch.column("text")
            for i in np.unique(owner).tolist():
                places = [x.span() for x in _TOKEN.finditer(texts[i].as_py())]
                base = int(ends[i] - sizes[i])
                spans[i] = [{"start": places[h - base][0], "end": places[h - base][1], "p": float(p[h])} for h in hits[owner == i].tolist()]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)),
                    pa.array([len(x) for x in spans], pa.int64()), pa.array(spans, kind),
                ],
                ["doc_id", "held_out", "score", "predicted", "n_toxic", "spans"],
            )

    return with_id(docs, held_out.alias("held_out")).mapInArrow(run, SCHEMA)


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that the model predicts to be toxic; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _, odds in _whole(batches, shared.value):
            yield batch.filter(pa.array(odds < 0))

    return docs.mapInArrow(run, docs.schema)


def fold(of: int, is_: int = 0):
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % of == is_
