"""Reads, changes and imports of the store, each as the table that results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallium.catalog import query
from recallium.functions import patterns as P
from recallium.sources import files
from recallium.sources.memories import BASE_SQL, DAY, NOW, USAGE_SQL, base, not_found, scope_filter, table, updated, usage


@query(f"WITH {BASE_SQL} SELECT doc_id, category, ts FROM base WHERE coalesce(scope, 'global') IN ('global') ORDER BY ts DESC, doc_id LIMIT 20 OFFSET 10")
def list_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir).where(scope_filter(["global"])).orderBy(F.desc("ts"), "doc_id")
    return rows.offset(10).limit(20).select("doc_id", "category", "ts")


@query(f"WITH {BASE_SQL} SELECT id, category, importance FROM base WHERE id = '77'")
def get_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).where(F.col("id") == "77").select("id", "category", "importance")


@query(f"WITH {BASE_SQL} SELECT id, category FROM base WHERE id IN ('1', '5', '250', '999999')")
def get_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).where(F.col("id").isin("1", "5", "250", "999999")).select("id", "category")


@query("SELECT count(*) AS n FROM documents")
def count_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {BASE_SQL} SELECT doc_id, ts FROM base WHERE ts < {NOW - 60 * DAY} ORDER BY ts, doc_id LIMIT 200")
def compaction_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).where(F.col("ts") < NOW - 60 * DAY).orderBy("ts", "doc_id").limit(200).select("doc_id", "ts")


_CHANGES = "changes AS (SELECT doc_id * 3 AS doc_id, CASE WHEN doc_id % 2 = 0 THEN 'decision' END AS category, 0.95 AS importance FROM documents WHERE doc_id % 4 < 2)"


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").where(i % 4 < 2).select((i * 3).alias("doc_id"), F.when(i % 2 == 0, "decision").alias("category"), F.lit(0.95).alias("importance"))


@query(f"WITH {BASE_SQL}, {_CHANGES} SELECT b.doc_id, coalesce(c.category, b.category) AS category, CAST(coalesce(c.importance, b.importance) AS DOUBLE) AS importance, b.ts FROM base b LEFT JOIN changes c USING (doc_id)")
def update_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updated(base(spark, sf_dir).select("doc_id", "category", "importance", "ts"), changes(spark, sf_dir))


@query(f"WITH {_CHANGES} SELECT doc_id FROM changes WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def failed_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_found(table(spark, sf_dir, "documents"), changes(spark, sf_dir))


@query(f"WITH {BASE_SQL} SELECT doc_id FROM base WHERE NOT coalesce(scope = 'global' AND ts < {NOW - 30 * DAY}, false)")
def bulk_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left; the scope test is strict, a null scope is not deleted."""
    gone = (F.col("scope") == "global") & (F.col("ts") < NOW - 30 * DAY)
    return base(spark, sf_dir).where(~F.coalesce(gone, F.lit(False))).select("doc_id")


@query(f"WITH {BASE_SQL} SELECT doc_id FROM base WHERE id NOT LIKE '12%' OR (SELECT count(*) FROM base WHERE id LIKE '12%') > 1")
def delete_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prefix deletes only when it names one row."""
    rows = base(spark, sf_dir).select("doc_id", "id")
    hits = rows.where(F.col("id").startswith("12")).agg(F.count(F.lit(1)).alias("hits"))
    return rows.crossJoin(F.broadcast(hits)).where(~F.col("id").startswith("12") | (F.col("hits") > 1)).select("doc_id")  # hits is one row


@query("SELECT item_id, trim(text) AS text, 'global' AS scope, CAST(0.7 AS DOUBLE) AS importance FROM (SELECT *, row_number() OVER (PARTITION BY trim(text) ORDER BY item_id) AS r FROM benchmark) WHERE length(trim(text)) >= 2 AND r = 1 AND trim(text) NOT IN (SELECT trim(text) FROM documents)")
def import_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults filled in, short and known texts left out, the first of equal texts kept."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.trim("text").alias("text")).where(F.length("text") >= 2)
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("text").orderBy("item_id"))).where("r = 1").drop("r")
    known = table(spark, sf_dir, "documents").select(F.trim("text").alias("text"))
    return first.join(known, "text", "left_anti").select("item_id", "text", F.lit("global").alias("scope"), F.lit(0.7).alias("importance"))


MARKDOWN = ["\ufeff- a first bullet, of some length\n* second one\r\n+ third bullet here\nno bullet at all, however long it may be\n-no space behind it\n- ab\n  - indented, so no bullet", "# Title\n\n*\ttab behind the star\n-  two blanks"]
_MD = " UNION ALL ".join("SELECT {} AS doc_id, '{}' AS text".format(-1 - i, t.replace("'", "''")) for i, t in enumerate(MARKDOWN))


@query(f"""WITH d AS (SELECT doc_id, text FROM documents UNION ALL {_MD}), l AS (SELECT doc_id, unnest(string_split_regex(ltrim(text, chr(65279)), '\r?\n')) AS line FROM d),
 t AS (SELECT doc_id, regexp_replace(substr(line, 3), '^\\s+|\\s+$', '', 'g') AS bullet FROM l WHERE regexp_matches(line, '^[-*+]\\s')) SELECT DISTINCT doc_id, bullet FROM t WHERE length(bullet) >= 5""")
def markdown_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bullets of at least five characters, once each a document."""
    samples = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(MARKDOWN)], "doc_id long, text string")
    return files.bullets(table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(samples), ["doc_id"], 5).distinct()


@query(f"WITH {BASE_SQL}, k AS (SELECT *, category || ':' || lower(text[1:60]) AS key FROM base) SELECT doc_id, row_number() OVER (PARTITION BY key ORDER BY ts DESC, doc_id) > 1 AS archived FROM k")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal keys the newest stays, the others are archived."""
    key = F.concat("category", F.lit(":"), F.lower(F.substring("text", 1, 60)))
    w = Window.partitionBy("key").orderBy(F.desc("ts"), "doc_id")
    return base(spark, sf_dir).withColumn("key", key).select("doc_id", (F.row_number().over(w) > 1).alias("archived"))


@query(f"WITH {USAGE_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY category, source ORDER BY ts DESC, doc_id) AS r, lag(doc_id) OVER (PARTITION BY category, source ORDER BY ts DESC, doc_id) AS newer, lag(ts) OVER (PARTITION BY category, source ORDER BY ts DESC, doc_id) AS newer_ts FROM usage) SELECT doc_id, newer AS superseded_by, newer_ts AS invalid_from FROM k WHERE r > 1")
def supersede_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each older version points to the next newer one of its fact, which ends its validity."""
    w = Window.partitionBy("category", "source").orderBy(F.desc("ts"), "doc_id")
    rows = usage(spark, sf_dir).select("doc_id", F.lag("doc_id").over(w).alias("superseded_by"), F.lag("ts").over(w).alias("invalid_from"), F.row_number().over(w).alias("r"))
    return rows.where("r > 1").drop("r")


@query(f"""WITH {BASE_SQL}, m AS (SELECT doc_id, '{{"tier":"' || CASE doc_id % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'odd' ELSE 'peripheral' END || '","access_count":"' || doc_id % 7 || '","confidence":' || CASE WHEN doc_id % 2 = 0 THEN '0.4' ELSE '1.7' END || CASE WHEN doc_id % 5 = 0 THEN '' ELSE '}}' END AS metadata FROM base),
 j AS (SELECT doc_id, CASE WHEN json_valid(metadata) THEN metadata END AS m FROM m) SELECT doc_id, CASE WHEN m->>'$.tier' IN ('core', 'working', 'peripheral') THEN m->>'$.tier' ELSE 'working' END AS tier, coalesce(CAST(m->>'$.access_count' AS BIGINT), 0) AS access_count,
 coalesce(least(1.0, CAST(m->>'$.confidence' AS DOUBLE)), 0.7) AS confidence, m IS NULL AS legacy FROM j""")
def parse_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tolerant reading of JSON metadata: malformed text gives the defaults, unknown tiers working, values out of range the nearest bound."""
    i = F.col("doc_id")
    tier = F.when(i % 3 == 0, "core").when(i % 3 == 1, "odd").otherwise("peripheral")
    text = F.concat(F.lit('{"tier":"'), tier, F.lit('","access_count":"'), (i % 7).cast("string"), F.lit('","confidence":'), F.when(i % 2 == 0, "0.4").otherwise("1.7"), F.when(i % 5 == 0, "").otherwise("}"))
    rows = base(spark, sf_dir).select("doc_id", F.try_parse_json(text).alias("m"))
    get = lambda p, t: F.try_variant_get("m", p, t)
    tiers = get("$.tier", "string")
    return rows.select(
        "doc_id", F.when(tiers.isin("core", "working", "peripheral"), tiers).otherwise("working").alias("tier"), F.coalesce(get("$.access_count", "string").cast("long"), F.lit(0)).alias("access_count"),
        F.coalesce(F.least(F.lit(1.0), get("$.confidence", "double")), F.lit(0.7)).alias("confidence"), F.col("m").isNull().alias("legacy"),
    )


@query("SELECT doc_id, length(trim(text)) < 2 OR substr(text, 1, 60) <> substr(lower(text), 1, 60) AS stale FROM documents")
def stale_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored summary (here the lower-case opening) no longer starts like the text."""
    return table(spark, sf_dir, "documents").select("doc_id", ((F.length(F.trim("text")) < 2) | (F.substring("text", 1, 60) != F.substring(F.lower("text"), 1, 60))).alias("stale"))


@query(f"""WITH {BASE_SQL}, l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM base),
 f AS (SELECT source, lower(trim(line)) AS key, min((doc_id, pos)) AS first FROM l WHERE trim(line) <> '' GROUP BY 1, 2), g AS (SELECT source, count(*) AS lines, min(first) AS first FROM f GROUP BY 1) SELECT source, lines, first[1] AS first_doc, first[2] AS first_pos FROM g""")
def merge_cluster_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a cluster, once each without regard to case, at their first place. Lines move as 128-bit digests."""
    lines = base(spark, sf_dir).select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.trim("line") != "")
    first = lines.groupBy("source", F.md5(F.lower(F.trim("line")).cast("binary")).alias("key")).agg(F.min(F.struct("doc_id", (F.col("pos") + 1).cast("long").alias("pos"))).alias("first"))
    merged = first.groupBy("source").agg(F.count(F.lit(1)).alias("lines"), F.min("first").alias("first"))
    return merged.select("source", "lines", F.col("first.doc_id").alias("first_doc"), F.col("first.pos").alias("first_pos"))


@query(f"""WITH {BASE_SQL}, g AS (SELECT source, category, count(*) AS n, max(importance) AS top, min(doc_id) AS first FROM base GROUP BY 1, 2) SELECT source, category FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, top DESC, first) AS r FROM g) WHERE r = 1""")
def plurality_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = base(spark, sf_dir).groupBy("source", "category").agg(F.count(F.lit(1)).alias("n"), F.max("importance").alias("top"), F.min("doc_id").alias("first"))
    return g.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), F.desc("top"), "first"))).where("r = 1").select("source", "category")


_LINE_KEY = "lower(trim(regexp_replace(line, '\\s+', ' ', 'g')))"


@query(f"""WITH {BASE_SQL}, l AS (SELECT doc_id, source, ts, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM base),
 s AS (SELECT *, {_LINE_KEY} AS key, 1.0 / (1 + exp(0.25 * (({NOW} - ts) / {DAY}.0 - 45))) AS score FROM l),
 g AS (SELECT source, key, round(sum(score), 9) AS total, arg_max(line, (ts, doc_id, pos)) AS line, max(ts) AS latest FROM s WHERE key <> '' GROUP BY 1, 2)
 SELECT source, line, round(total, 6) AS score FROM g QUALIFY row_number() OVER (PARTITION BY source ORDER BY total DESC, latest DESC, key) <= 8""")
def reflection_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of equal lines add up; the latest wording is shown; the best eight lines a source."""
    lines = base(spark, sf_dir).select("source", "doc_id", "ts", F.posexplode(F.split("text", "\n")).alias("pos", "line"), (1.0 / (1 + F.exp(0.25 * ((NOW - F.col("ts")) / float(DAY) - 45)))).alias("score"))
    s = lines.withColumn("key", F.lower(F.trim(F.regexp_replace("line", r"\s+", " ")))).where("key <> ''")
    g = s.groupBy("source", "key").agg(F.round(F.sum("score"), 9).alias("total"), F.max(F.struct("ts", "doc_id", "pos", "line")).alias("latest"))
    w = Window.partitionBy("source").orderBy(F.desc("total"), F.desc("latest.ts"), "key")
    return g.withColumn("r", F.row_number().over(w)).where("r <= 8").select("source", F.col("latest.line").alias("line"), F.round("total", 6).alias("score"))


@query(f"WITH n AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM documents) SELECT doc_id FROM n WHERE NOT (length(s) < 5 OR {P.any_sql('s', P.DENIAL + P.META_QUESTION + P.BOILERPLATE + P.DIAGNOSTIC + P.PLATFORM)})")
def noise_free_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).where(~P.is_noise(F.col("text"))).select("doc_id")
