"""How far a conversation supports a candidate memory."""

from __future__ import annotations

import re

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = regex.compile(r"\p{Han}|[[\p{L}\p{N}]--\p{Han}]+", regex.V1)


def tokens(text: str) -> list[str]:
    """Runs of letters and digits; each Han character by itself."""
    return _TOKEN.findall(text.lower())


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a bit for each token of a."""
    places: dict[str, int] = {}
    for i, t in enumerate(a):
        places[t] = places.get(t, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_ = full
    for t in b:
        hit = open_ & places.get(t, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return len(a) - open_.bit_count()


def f1(a: list[str], b: list[str]) -> float:
    return 2 * common_length(a, b) / (len(a) + len(b)) if a and b else 0.0


def spans(text: str) -> list[str]:
    """Lines, and sentences of four characters or more in them."""
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    return lines + [s for x in lines for s in map(str.strip, re.split(r"[。！？!?]+", x)) if len(s) >= 4]


def confidence_support(candidates: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, best, coverage, score. candidates: conv_id, candidate (one a conversation); turns: conv_id, text.

    score = clamp(0.7 best + 0.3 coverage - 0.25 (1 - coverage)); a candidate without tokens, or one without turns, scores 0.
    Turns are looked at one by one and combined by maximum and distinct count, so a long conversation is not gathered."""

    @F.pandas_udf("best double, hits array<string>")
    def compare(candidate: pd.Series, text: pd.Series) -> pd.DataFrame:
        out = []
        for c, t in zip(candidate.fillna(""), text.fillna(""), strict=True):
            mine = tokens(c)
            out.append((max((f1(mine, tokens(s)) for s in set(spans(t))), default=0.0), sorted(set(mine) & set(tokens(t)))))
        return pd.DataFrame(out, columns=["best", "hits"])

    @F.pandas_udf("int")
    def distinct(candidate: pd.Series) -> pd.Series:
        return candidate.fillna("").map(lambda c: len(set(tokens(c))))

    asked = candidates.select("conv_id", "candidate")
    seen = turns.select("conv_id", "text").join(asked, "conv_id").select("conv_id", compare("candidate", "text").alias("c")).select("conv_id", "c.*")
    per_token = seen.select("conv_id", "best", F.explode_outer("hits").alias("hit")).groupBy("conv_id", "hit").agg(F.max("best").alias("best"))
    found = per_token.groupBy("conv_id").agg(F.max("best").alias("best"), F.count("hit").alias("hits"))
    rows = asked.select("conv_id", distinct("candidate").alias("n")).join(found, "conv_id", "left")
    coverage = F.when(F.col("n") > 0, F.coalesce("hits", F.lit(0)) / F.col("n")).otherwise(0.0)
    rows = rows.select("conv_id", F.coalesce("best", F.lit(0.0)).alias("best"), coverage.alias("coverage"))
    score = 0.7 * F.col("best") + 0.3 * F.col("coverage") - 0.25 * (1 - F.col("coverage"))
    return rows.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
