"""Mixing sources to target weights.

Tokens are aggregated by source; each source's target follows its weight, but for a cap at a multiple of its own size,
and what the cap takes is shared again by weight among the others. Its rate is target over size: each document is
emitted floor(rate) times, and once more with a chance of the rate's fraction, by a draw that is hashed from its id.

The draws of a source are systematic. Its documents stand in order of size, those of equal size in order of a number hashed from the id,
and with one hashed start u for the source the document at place i gets its further copy where floor(u + i * fraction) rises. So each
document's chance is exactly the fraction, the number of copies is exact within one, and, as neighbours are of like size, the words are near
the target even where a source has few, long documents. (A draw for each document by itself strays: at sf0.01 the worst source was off by
0.72 of its target.) No order of all documents is needed for this: the sizes' counts say how many of each size are copied, and these are
the ones of the least numbers, up to a limit that is found in a histogram of the numbers and then in one of its buckets. Given these
limits, one a source and size, each document is decided by its own row. Reruns agree.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a null id is hashed as the
empty string; repeated rows are decided alike; sources of size 0 have target 0; an empty table gives no rows; other columns are
carried along only where rows are emitted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallium.llm.common import WORD, Staged

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
SEED = "mix"
#: Tables with a row for each source, or each source and size, are broadcast up to this many rows; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Hashed numbers have NUMBER_BITS bits, of which the first BUCKET_BITS are a bucket.
NUMBER_BITS, BUCKET_BITS = 60, 12


def size_of(text: Column) -> Column:
    """Number of words: what is left when each is replaced by one character and the white space goes."""
    one = F.regexp_replace(text, WORD, "x")
    return F.coalesce(F.length(F.translate(one, " \t\n\r\x0b\x0c", "")), F.lit(0)).cast("long")


def number(*of: Column) -> Column:
    """A whole number of NUMBER_BITS bits, hashed."""
    digest = F.sha2(F.concat_ws(":", F.lit(SEED), *(F.coalesce(c.cast("string"), F.lit("")) for c in of)), 256)
    return F.conv(F.substring(digest, 1, NUMBER_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> also target. With caps of CAP times the size, sharing anew until no source is above its cap
    gives min(cap, share * weight), where the capped sources are those with the least cap/weight; share follows from running
    sums in that order. The table has one row a source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1)
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.lit(CAP) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    # the share that would hold if exactly the sources before this one were capped; the first that stays below its cap sets it
    rows = rows.withColumn(
        "share",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    rows = rows.withColumn("final", F.min(F.when(F.col("share") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "share"))).over(every)["share"])
    return rows.select("source", "source_size", F.least("cap", F.coalesce(F.col("final") * F.col("weight"), F.col("cap"))).alias("target"))


def _limits(sized: DataFrame) -> DataFrame:
    """source, size, source_size, target, rate, limit: documents with a number up to the limit get the further copy. sized: doc_id, source, size."""
    counts = Staged(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes").df
    plan = targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size")))
    plan = plan.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    start = number(F.lit("start"), F.col("source"), F.col("source").isNull()) / F.lit(float(1 << NUMBER_BITS))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = F.col("rate") - F.floor("rate")
    classes = _join(counts, plan, "source").withColumn("before", before).withColumn("take", (F.floor(start + (F.col("before") + F.col("n")) * part) - F.floor(start + F.col("before") * part)).cast("long"))
    classes = Staged(classes.drop("before"), "mix-classes").df
    # only where some of a size are copied and some are not a limit must be found
    some = classes.where("take > 0 AND take < n").select("source", "size", "take")
    rows = _join(sized, some, "source", "size").select("source", "size", "take", number(F.col("doc_id")).alias("number"))
    rows = rows.withColumn("bucket", F.shiftright("number", NUMBER_BITS - BUCKET_BITS))
    buckets = rows.groupBy("source", "size", "take", "bucket").agg(F.count(F.lit(1)).alias("m"))
    up_to = F.sum("m").over(Window.partitionBy("source", "size").orderBy("bucket"))
    chosen = buckets.withColumn("up_to", up_to).where("up_to >= take AND up_to - m < take").select("source", "size", "bucket", (F.col("take") - F.col("up_to") + F.col("m")).alias("need"))
    last = F.row_number().over(Window.partitionBy("source", "size").orderBy("number"))
    found = _join(rows.drop("take"), chosen, "source", "size", "bucket").withColumn("place", last).where("place = need").select("source", "size", F.col("number").alias("found"))
    limits = _join(classes, found, "source", "size", how="left")
    limit = F.when(F.col("take") == 0, -1).when(F.col("take") >= F.col("n"), 1 << NUMBER_BITS).otherwise(F.col("found"))
    return Staged(limits.select("source", "size", "source_size", "target", "rate", limit.alias("limit")), "mix-limits").df


def _join(rows: DataFrame, table: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """Null keys meet as equals. A small table, by its checked size, is broadcast."""
    few = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    right = table.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(F.broadcast(right) if few else right, same, how).drop(*(f"_{k}" for k in keys))


def _copies() -> Column:
    return (F.floor("rate") + F.when(number(F.col("doc_id")) <= F.col("limit"), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, copies of each row."""
    # texts are read once; what follows works on the three columns written here
    sized = Staged(docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size")), "sizes").df
    return _join(sized, _limits(sized), "source", "size").select("doc_id", "size", "source_size", "target", _copies().alias("copies"))


def emit(docs: DataFrame) -> DataFrame:
    """The rows of docs themselves, each as many times as mix() says; all columns of docs stay."""
    names = docs.columns
    # the working columns stand in one struct, so that docs can have columns of any name
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"))
    limits = _limits(Staged(rows.select("doc_id", "source", "size"), "sizes").df)
    rows = _join(rows, limits, "source", "size").withColumn("copies", _copies())
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1))))).where("copies >= 1").select("row.*")
