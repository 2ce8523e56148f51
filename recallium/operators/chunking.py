"""Cutting long texts into overlapping chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CJK = r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}]"
# Context limits of embedding models, in tokens.
MODEL_LIMITS = {
    "jina-embeddings-v5-text-small": 8192, "jina-embeddings-v5-text-nano": 8192, "text-embedding-3-small": 8192, "text-embedding-3-large": 8192, "text-embedding-004": 8192,
    "gemini-embedding-001": 2048, "nomic-embed-text": 8192, "all-MiniLM-L6-v2": 512, "all-mpnet-base-v2": 512,
}
DEFAULT_LIMIT, LINES = 8192, 50
_BREAK, _SENTENCE = re.compile(r"\r\n|\n|\r"), re.compile(r"[.!?。！？]")


def settings(text: Column, model: str | None) -> Column:
    """most, overlap and least characters of a chunk: 70, 5 and 10 per cent of the model's limit, less for texts that are mostly CJK."""
    limit = MODEL_LIMITS.get(model or "", DEFAULT_LIMIT)
    t = F.coalesce(text, F.lit(""))
    share = F.regexp_count(t, F.lit(CJK)) / F.greatest(F.lit(1), F.regexp_count(t, F.lit(r"[^ \t\n\x0b\f\r]"))).cast("double")
    part = lambda x: F.floor(F.lit(limit * x) / F.when(share > 0.3, 2.5).otherwise(1.0)).cast("int")
    return F.struct(F.greatest(F.lit(200), part(0.7)).alias("most"), part(0.05).alias("overlap"), F.greatest(F.lit(100), part(0.1)).alias("least"))


def _last(pattern: re.Pattern, text: str, low: int, high: int) -> int | None:
    """Where the last match that begins in low..high-1 begins."""
    width = 256
    while high > low:
        start = max(low, high - width)
        found = [m.start() for m in pattern.finditer(text, start, high)]
        if found:
            return found[-1]
        high, width = start, width * 2
    return None


_LINE, _SPACE = re.compile(r"\n"), re.compile(r"\s")


def cut_after(text: str, start: int, most: int, least: int, lines: int = LINES) -> int:
    """The end of the chunk that begins at start: the line limit first, then the last sentence end, line end or white space."""
    high = min(len(text), start + most)
    low = min(max(start + least, start + 1), high)
    if lines and len(_BREAK.findall(text, start, high)) >= lines:
        ends = [m.end() for _, m in zip(range(lines), _LINE.finditer(text, start, high), strict=False)]
        if len(ends) == lines:
            return max(ends[-1], low)
    at = _last(_SENTENCE, text, low, high)
    if at is not None:
        at += 1
        while at < high and text[at].isspace():
            at += 1
        return at
    at = _last(_LINE, text, low, high)
    if at is not None:
        return at + 1
    at = _last(_SPACE, text, low, high)
    return high if at is None else at


def ranges(text: str, most: int = 4000, overlap: int = 200, least: int = 200) -> list[tuple[int, int]]:
    """Code-point ranges of the chunks, without the white space around them."""

    def trimmed(a: int, b: int) -> tuple[int, int]:
        part = text[a:b]
        return a + len(part) - len(part.lstrip()), a + len(part.rstrip())

    out, at = [], 0
    while at < len(text) and text.strip():
        end = len(text) if len(text) - at <= most else cut_after(text, at, most, least)
        a, b = trimmed(at, end)
        if end < len(text) and b - a < least:  # too little is left: cut at the limit
            end = min(len(text), at + most)
            a, b = trimmed(at, end)
        if b > a:
            out.append((a, b))
        if end >= len(text):
            break
        at = max(end - overlap, at + 1)
    return out


def chunks(docs: DataFrame, sizes: Column | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, chunk (from 0), start, end. sizes: a struct as of settings()."""
    sizes = sizes if sizes is not None else F.struct(F.lit(4000).alias("most"), F.lit(200).alias("overlap"), F.lit(200).alias("least"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d, k, a, b) for d, t, m, o, n in zip(f["doc_id"], f["text"].fillna(""), f["most"], f["overlap"], f["least"], strict=True) for k, (a, b) in enumerate(ranges(t, m, o, n))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "start", "end"])

    return docs.select("doc_id", "text", sizes.alias("c")).select("doc_id", "text", "c.*").mapInPandas(run, "doc_id long, chunk int, start long, end long")
