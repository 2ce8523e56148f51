"""Quality rules by compression bands.

A document is compressed whole and in fixed chunks. Repetitive text compresses too well, random text too badly; how
well clean prose compresses depends on its length, so each limit is a line through points (bytes, ratio).

Defined cases: a null text counts as empty; texts without words fail the base rule; repeated rows give equal rows;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from recallium.llm.common import with_id

#: (bytes, least ratio, greatest ratio) of a whole document at zstandard level 3; between points the limits go along log2 of the bytes.
WHOLE = ((128, 0.50, 1.40), (256, 0.515, 1.00), (512, 0.505, 0.80), (1024, 0.482, 0.70), (2048, 0.457, 0.62), (4096, 0.436, 0.58), (8192, 0.416, 0.56), (16384, 0.400, 0.55), (65536, 0.375, 0.54))
#: The limits of one chunk.
CHUNK_BYTES, CHUNK_LEAST, CHUNK_MOST = 2048, 0.435, 0.66
LEVEL = 3
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
_WORDY = re.compile(r"[^\x20\x09-\x0D]")

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean,"
    " n_bytes long, ratio double, chunk_min double, chunk_max double, reason string"
)


def repeat_words(words: list) -> int:
    """Words that stand in a 3-word window found twice or more."""
    grams = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(grams)) == len(grams):
        return 0
    found, marked = Counter(grams), bytearray(len(words))
    for i, g in enumerate(grams):
        if found[g] > 1:
            marked[i] = marked[i + 1] = marked[i + 2] = 1
    return sum(marked)


def dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if _WORDY.search(x)]
    return len(lines) - len(set(lines))


def limits(n_bytes: int, points=WHOLE) -> tuple[float, float]:
    at, xs = np.log2(max(1, n_bytes)), [np.log2(p[0]) for p in points]
    return float(np.interp(at, xs, [p[1] for p in points])), float(np.interp(at, xs, [p[2] for p in points]))


class Bands:
    """Ratios of a text and the verdict on them."""

    def __init__(self, whole=WHOLE, chunk_bytes: int = CHUNK_BYTES, chunk_least: float = CHUNK_LEAST, chunk_most: float = CHUNK_MOST, level: int = LEVEL):
        self.zip = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self.whole, self.chunk_bytes, self.chunk_least, self.chunk_most = whole, chunk_bytes, chunk_least, chunk_most

    def ratio(self, data: bytes) -> float:
        return len(self.zip.compress(data)) / len(data)

    def judge(self, data: bytes) -> tuple[float, float, float, str]:
        """Whole ratio, least and greatest chunk ratio, and what speaks against the text."""
        if not data:
            return 1.0, 1.0, 1.0, "empty"
        whole, n = self.ratio(data), self.chunk_bytes
        # the rest of a text joins the chunk before it when it is shorter than half a chunk
        cuts = list(range(0, max(1, len(data) - n // 2), n))
        each = [whole] if len(cuts) == 1 else [self.ratio(data[i : (i + n if k + 1 < len(cuts) else len(data))]) for k, i in enumerate(cuts)]
        least, most = limits(len(data), self.whole)
        lo, hi = min(each), max(each)
        if whole < least:
            return whole, lo, hi, "repetitive"
        if whole > most:
            return whole, lo, hi, "incompressible"
        if len(each) > 1 and lo < self.chunk_least:
            return whole, lo, hi, "repetitive chunk"
        if len(each) > 1 and hi > self.chunk_most:
            return whole, lo, hi, "incompressible chunk"
        return whole, lo, hi, ""


def row(text: str, bands: Bands) -> tuple:
    data = text.encode()
    words = data.split()
    n_repeat = repeat_words(words)
    failed = len(words) < 50 or 100 * n_repeat > 50 * len(words)
    whole, lo, hi, reason = bands.judge(data)
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup_lines(text), n_repeat,
        failed, not failed and not reason, len(data), whole, lo, hi, "base rule" if failed else reason,
    )


def quality_rules(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: the base counts, the ratios and the verdict (SCHEMA)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(**options)
        for batch in batches:
            rows = [row(t or "", bands) for t in batch.column("text").to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 12
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] + [pa.float64()] * 3 + [pa.string()]
            names = [x.split()[0] for x in SCHEMA.split(",")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return with_id(docs).mapInArrow(run, SCHEMA)
