"""Audit of how document filters interact: for every order of the filters, what each one removes, and what others had removed before.

The words of each text go through a relational pipeline: explode words, aggregate by document and word, then by document for totals
and distinct words. The other flags are outer-joined, and 32 conditional counts, one for each set of failed filters, hold all that
the 120 orders need; the documents are read no more after that.

Defined cases: a null text is empty (it fails A, and E where a smaller id has an empty text too). Rows that repeat a doc_id count each;
a null doc_id has no smaller id and no labels. A null source is the part ''. Repeated labels of a document count once, by the greatest
value. An empty table has no parts and gives no rows. Other columns of the tables are not read."""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallium.llm.common import Staged, looked_up, with_id

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
SETS = 1 << len(FILTERS)
_SPACE = r"[\x20\x09-\x0D]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _form() -> Column:
    """What tells the texts of one document id apart where the id is repeated."""
    return F.xxhash64("text")


def word_totals(docs: DataFrame) -> DataFrame:
    """doc_id, form, n_pairs, n_distinct: word occurrences and distinct words of each text that has words. docs: doc_id, text.

    The texts are dealt out by document, so both aggregations run where the words are exploded and words are never shuffled. Rows that
    repeat both id and text are counted together: n_pairs is then a multiple of their number."""
    dealt = docs.select("doc_id", _form().alias("form"), "text").repartition("doc_id", "form")
    words = dealt.select("doc_id", "form", F.explode(F.split("text", _SPACE)).alias("word")).where("word <> ''")
    by_word = words.groupBy("doc_id", "form", "word").agg(F.count(F.lit(1)).alias("n"))
    return by_word.groupBy("doc_id", "form").agg(F.sum("n").alias("n_pairs"), F.count(F.lit(1)).alias("n_distinct"))


def _same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & left[n].eqNullSafe(right[n])
    return out


def facts(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest, n_words, n_distinct, capitals, symbols: a row for each row of documents, without its text."""
    texts = with_id(docs, F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part")).withColumn("text", F.coalesce("text", F.lit("")))
    flags = texts.select(
        "doc_id", "part", _form().alias("form"), F.sha2("text", 256).alias("digest"),
        (100 * (F.length("text") - F.length(F.translate("text", _CAPITALS, ""))) > 2 * F.length("text")).alias("capitals"), F.col("text").rlike(r"[#$%&*|]").alias("symbols"),
    )
    totals = word_totals(texts)
    copies = flags.groupBy("doc_id", "form").agg(F.count(F.lit(1)).alias("n_rows"))
    per_text = copies.join(totals, _same(copies, totals, "doc_id", "form"), "left").select(
        copies["doc_id"], copies["form"], (F.coalesce("n_pairs", F.lit(0)) / F.col("n_rows")).cast("long").alias("n_words"), F.coalesce("n_distinct", F.lit(0)).alias("n_distinct")
    )
    per_text = per_text.withColumnsRenamed({"doc_id": "of_id", "form": "of_form"})
    return flags.join(per_text, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("form") == F.col("of_form")), "left").drop("of_id", "of_form", "form")


def failed_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, and for each set of failed filters (bit i: filter i fails) the numbers of documents, of good and of toxic ones:
    m0 .. m31, good0 .. good31, toxic0 .. toxic31."""
    stored = Staged(facts(docs), "audit-facts")
    rows = stored.df
    total = rows.count()
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("weight"))
    rows = looked_up(rows, firsts, "digest", total, "inner")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id IS NOT NULL")
    marks = marks.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("bad"))
    rows = rows.join(marks, "doc_id", "left")
    fails = [F.col("n_words") < 200, 100 * F.col("n_distinct") < 50 * F.col("n_words"), F.col("capitals"), F.col("symbols"), F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(False))]
    failed = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    kinds = {"m": F.lit(True), "good": F.coalesce("good", F.lit(False)), "toxic": F.coalesce("bad", F.lit(False))}
    rows = rows.select("part", failed.alias("failed"), *(v.alias(f"is_{k}") for k, v in kinds.items()))
    counts = Staged(rows.groupBy("part").agg(*(F.count_if((F.col("failed") == s) & F.col(f"is_{k}")).alias(f"{k}{s}") for k in kinds for s in range(SETS))), "audit-sets")
    stored.drop()
    return counts.df


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley. docs: doc_id, text, source; labels: doc_id, quality, toxic."""
    sets = failed_sets(docs, labels)
    arrays = [F.array(*(F.col(f"{k}{s}") for s in range(SETS))).alias(k) for k in ("m", "good", "toxic")]
    at: dict[tuple[int, int], list[tuple[str, int]]] = {}  # a filter and the set of those before it: the orders and steps where it is so
    for order in ORDERS:
        for step, own in enumerate(order):
            at.setdefault((1 << FILTERS.index(own), sum(1 << FILTERS.index(f) for f in order[:step])), []).append((order, step + 1))
    plan = json.dumps([{"own": own, "before": before, "places": [{"filter_order": o, "step": n} for o, n in found]} for (own, before), found in at.items()])
    literal = F.from_json(F.lit(plan), "array<struct<own: int, before: int, places: array<struct<filter_order: string, step: int>>>>")
    rows = sets.select("part", *arrays, F.explode(literal).alias("at")).select("part", "m", "good", "toxic", "at.*")

    def total(of: str, where: str, value: str = "{of}[s]") -> Column:
        return F.expr(f"aggregate(sequence(0, {SETS - 1}), 0L, (t, s) -> t + if({where}, {value.format(of=of)}, 0L))")

    removed, orders = "(s & own) <> 0 AND (s & before) = 0", len(ORDERS)
    counted = rows.select(
        "part", "places", total("m", "(s & (own | before)) = 0").alias("kept"), total("m", removed).alias("removed"),
        total("m", "(s & own) <> 0 AND (s & before) <> 0").alias("redundant"), F.expr("m[own]").alias("unique_fails"),
        total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"),
        # of the filters that a document fails, each comes first in as many orders as any other
        total("m", "(s & own) <> 0", f"{{of}}[s] * ({orders} div bit_count(s))").alias("shapley"),
    )
    return counted.select("part", F.explode("places").alias("place"), *counted.columns[2:]).select("part", "place.filter_order", "place.step", *counted.columns[2:])
