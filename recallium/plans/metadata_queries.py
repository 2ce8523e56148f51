"""Queries over JSON metadata, which is made from the id by one expression that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallium.catalog import query
from recallium.functions import metadata as M
from recallium.functions import rules as R
from recallium.sources.memories import BASE_SQL, NOW, base

#: The metadata of a row; some are malformed, some no object, some without what newer rows have.
META = """CASE doc_id % 23 WHEN 0 THEN '{"tier":' WHEN 1 THEN '[1]' WHEN 2 THEN '' ELSE '{"tier":"' || CASE doc_id % 4 WHEN 0 THEN 'core' WHEN 1 THEN 'odd' ELSE 'peripheral' END || '","access_count":' || CASE doc_id % 5 WHEN 0 THEN '-3' WHEN 1 THEN '"12"' WHEN 2 THEN '7.9' ELSE CAST(doc_id % 40 AS STRING) END
 || CASE doc_id % 3 WHEN 0 THEN ',"memory_category":"preferences"' WHEN 1 THEN ',"memory_category":"cases"' ELSE '' END || CASE doc_id % 7 WHEN 0 THEN ',"confidence":1.7' WHEN 1 THEN ',"confidence":0.25' ELSE '' END
 || CASE doc_id % 6 WHEN 0 THEN ',"source":"manual"' WHEN 1 THEN ',"source":"odd"' WHEN 2 THEN ',"type":"session-summary"' WHEN 3 THEN ',"type":"memory-reflection"' ELSE '' END || CASE doc_id % 11 WHEN 0 THEN ',"state":"pending"' WHEN 1 THEN ',"state":"gone"' ELSE '' END
 || CASE doc_id % 8 WHEN 0 THEN ',"valid_from":1700000000000,"invalidated_at":1700000000500' WHEN 1 THEN ',"valid_from":1700000000000,"invalidated_at":1600000000000' WHEN 2 THEN ',"valid_from":0,"valid_until":1800000000000.5' ELSE '' END
 || CASE doc_id % 9 WHEN 0 THEN ',"l0_abstract":"  Topic ' || CAST(doc_id % 4 AS STRING) || ': likes tea  "' WHEN 1 THEN ',"l0_abstract":"   "' WHEN 2 THEN ',"l0_abstract":5' ELSE '' END || CASE doc_id % 10 WHEN 0 THEN ',"fact_key":"preferences:x"' WHEN 1 THEN ',"superseded_by":"77"' ELSE '' END
 || CASE doc_id % 12 WHEN 0 THEN ',"memory_temporal_type":"dynamic"' WHEN 1 THEN ',"memory_temporal_type":"never"' ELSE '' END || ',"injected_count":' || CAST(doc_id % 13 AS STRING) || CASE doc_id % 2 WHEN 0 THEN ',"admission_control":{"decision":"' || CASE doc_id % 4 WHEN 0 THEN 'pass_to_dedup' ELSE 'reject' END || '","evaluated_at":' || CAST(1700000000000 + doc_id AS STRING) || '}' ELSE '' END || '}' END"""
_R = f"{BASE_SQL}, raw AS (SELECT *, {META} AS metadata FROM base), j AS (SELECT *, CASE WHEN json_valid(metadata) AND json_type(CASE WHEN json_valid(metadata) THEN metadata END) = 'OBJECT' THEN metadata END AS m FROM raw)"
_S = lambda p: f"CASE WHEN json_type(m, '$.{p}') = 'VARCHAR' THEN nullif(regexp_replace(m->>'$.{p}', '^\\s+|\\s+$', '', 'g'), '') END"
_N = lambda p: f"TRY_CAST(m->>'$.{p}' AS DOUBLE)"
_COUNT = lambda p, o: f"CAST(CASE WHEN {_N(p)} >= 0 THEN floor({_N(p)}) ELSE {o} END AS BIGINT)"
_TIME = lambda p: f"CAST(CASE WHEN {_N(p)} > 0 THEN floor({_N(p)}) END AS BIGINT)"
_TOPIC = "CASE WHEN regexp_extract(l0, '^(.{1,120}?)[：:]', 1) <> '' THEN regexp_extract(l0, '^(.{1,120}?)[：:]', 1) WHEN regexp_extract(l0, '^(.{1,120}?)(?:\\s*->|\\s*=>)', 1) <> '' THEN regexp_extract(l0, '^(.{1,120}?)(?:\\s*->|\\s*=>)', 1) ELSE l0 END"
_KEY = f"trim(regexp_replace(regexp_replace(lower({_TOPIC}), '\\s+', ' ', 'g'), '[。.!?]+$', ''))"
_SMART = f"""{_R}, k AS (SELECT *, {R.LEGACY_CATEGORY_SQL} AS old_category, CASE WHEN m->>'$.source' IS NOT NULL THEN CASE WHEN m->>'$.source' IN ('manual', 'auto-capture', 'reflection', 'session-summary', 'legacy') THEN m->>'$.source' ELSE 'legacy' END WHEN {_S('type')} = 'session-summary' THEN 'session-summary' WHEN {_S('type')} IN ('memory-reflection', 'memory-reflection-item') THEN 'reflection' ELSE 'legacy' END AS new_source, coalesce({_S('l0_abstract')}, text) AS l0 FROM j),
 s AS (SELECT *, CASE WHEN coalesce(m->>'$.state', CASE WHEN new_source = 'session-summary' THEN 'archived' ELSE 'confirmed' END) IN ('pending', 'confirmed', 'archived') THEN coalesce(m->>'$.state', CASE WHEN new_source = 'session-summary' THEN 'archived' ELSE 'confirmed' END) ELSE 'confirmed' END AS state, coalesce({_S('memory_category')}, old_category) AS memory_category, coalesce({_TIME('valid_from')}, ts) AS valid_from FROM k),
 smart AS (SELECT doc_id, id, scope, category, importance, ts, text, l0 AS l0_abstract, coalesce({_S('l1_overview')}, '- ' || l0) AS l1_overview, coalesce({_S('l2_content')}, text) AS l2_content, memory_category, CASE WHEN {_S('tier')} IN ('core', 'working', 'peripheral') THEN {_S('tier')} ELSE 'working' END AS tier, {_COUNT('access_count', '0')} AS access_count,
 coalesce(least(1.0, greatest(0.0, CAST(CASE WHEN json_type(m, '$.confidence') IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN m->>'$.confidence' END AS DOUBLE))), 0.7) AS confidence, {_COUNT('last_accessed_at', 'ts')} AS last_accessed_at, valid_from, CASE WHEN {_TIME('invalidated_at')} >= valid_from THEN {_TIME('invalidated_at')} END AS invalidated_at,
 CASE WHEN {_S('memory_temporal_type')} IN ('static', 'dynamic') THEN {_S('memory_temporal_type')} END AS temporal_type, {_TIME('valid_until')} AS valid_until, coalesce({_S('fact_key')}, CASE WHEN memory_category IN ('preferences', 'entities') AND {_KEY} <> '' THEN memory_category || ':' || {_KEY} END) AS fact_key, {_S('superseded_by')} AS superseded_by, state, new_source AS source,
 CASE WHEN new_source IN ('reflection', 'session-summary') THEN 'reflection' WHEN state = 'archived' THEN 'archive' WHEN old_category IN ('profile', 'preferences', 'events') THEN 'durable' ELSE 'working' END AS memory_layer, {_COUNT('injected_count', '0')} AS injected_count, {_COUNT('bad_recall_count', '0')} AS bad_recall_count, m IS NULL OR {_S('memory_category')} IS NULL AS legacy, m FROM s)"""
FIELDS = ["l0_abstract", "l1_overview", "l2_content", "memory_category", "tier", "access_count", "confidence", "last_accessed_at", "valid_from", "invalidated_at", "temporal_type", "valid_until", "fact_key", "superseded_by", "state", "source", "memory_layer", "injected_count", "bad_recall_count", "legacy"]


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with their metadata as text and as a variant m."""
    return base(spark, sf_dir).drop("source").withColumn("metadata", F.expr(META)).withColumn("m", M.parsed(F.col("metadata")))


def smart_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir)
    return r.select("doc_id", "id", "scope", "category", "importance", "ts", "text", "m", *(c.alias(n) for n, c in M.smart(F.col("m"), F.col("text"), F.col("category"), F.col("ts")).items()))


@query(f"WITH {_SMART} SELECT doc_id, {', '.join(FIELDS)} FROM smart")
def smart_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of the metadata with its default."""
    return smart_rows(spark, sf_dir).select("doc_id", *FIELDS)


@query(f"WITH {_SMART} SELECT doc_id, importance, confidence, tier, access_count, ts AS created_at, CASE WHEN last_accessed_at > 0 THEN last_accessed_at ELSE ts END AS last_accessed_at, temporal_type FROM smart")
def lifecycle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the decay kernels need of a row."""
    last = F.when(F.col("last_accessed_at") > 0, F.col("last_accessed_at")).otherwise(F.col("ts"))
    return smart_rows(spark, sf_dir).select("doc_id", "importance", "confidence", "tier", "access_count", F.col("ts").alias("created_at"), last.alias("last_accessed_at"), "temporal_type")


@query(f"WITH {_SMART} SELECT category, count(*) AS total, count(*) FILTER (legacy) AS legacy FROM smart GROUP BY 1")
def legacy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a category of the newer kind, by category."""
    return smart_rows(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("total"), F.count_if("legacy").alias("legacy"))


_AUDIT = "CASE WHEN m->>'$.admission_control.decision' IN ('pass_to_dedup', 'reject') THEN m->>'$.admission_control.decision' END AS decision, coalesce(CASE WHEN TRY_CAST(m->>'$.admission_control.evaluated_at' AS DOUBLE) > 0 THEN CAST(m->>'$.admission_control.evaluated_at' AS BIGINT) END, CASE WHEN ts > 0 THEN ts END) AS decided_at"


def audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = smart_rows(spark, sf_dir)
    decision = F.try_variant_get("m", "$.admission_control.decision", "string")
    at = M.time_of(F.col("m"), "$.admission_control.evaluated_at")
    return r.select("doc_id", "scope", F.when(decision.isin("pass_to_dedup", "reject"), decision).alias("decision"), F.coalesce(at, F.when(F.col("ts") > 0, F.col("ts"))).alias("decided_at"), "memory_category")


@query(f"WITH {_SMART} SELECT doc_id, {_AUDIT}, memory_category FROM smart")
def admission_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision that admitted or rejected a row, when, and the category it was seen with."""
    return audits(spark, sf_dir).select("doc_id", "decision", "decided_at", "memory_category")


@query(f"""WITH {_SMART}, a AS (SELECT {_AUDIT}, memory_category FROM smart WHERE coalesce(scope, 'global') IN ('global', 'agent:src1'))
 SELECT memory_category, count(*) FILTER (decision = 'pass_to_dedup') AS admitted, count(*) FILTER (decision = 'reject') AS rejected, count(decision) AS observed, round(count(*) FILTER (decision = 'reject') / nullif(CAST(count(decision) AS DOUBLE), 0), 6) AS reject_rate,
 count(*) FILTER (decision = 'pass_to_dedup' AND decided_at >= {NOW} - 86400000) AS last_24h, max(CASE WHEN decision = 'reject' THEN decided_at END) AS latest_rejected_at FROM a GROUP BY 1""")
def admission_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admitted and rejected rows of two scopes by category, with rates and windows, in one aggregation."""
    a = audits(spark, sf_dir).where(F.coalesce("scope", F.lit("global")).isin("global", "agent:src1"))
    yes, no = F.col("decision") == "pass_to_dedup", F.col("decision") == "reject"
    counts = a.groupBy("memory_category").agg(F.count_if(yes).alias("admitted"), F.count_if(no).alias("rejected"), F.count("decision").alias("observed"), F.count_if(yes & (F.col("decided_at") >= NOW - 86400000)).alias("last_24h"), F.max(F.when(no, F.col("decided_at"))).alias("latest_rejected_at"))
    return counts.withColumn("reject_rate", F.round(F.col("rejected") / F.nullif(F.col("observed").cast("double"), F.lit(0.0)), 6))


_PATCH = """'{"tier":"core","note":' || CASE doc_id % 2 WHEN 0 THEN 'null' ELSE '"n' || CAST(doc_id % 3 AS STRING) || '"' END || '}'"""


@query(f"""WITH {_R} SELECT doc_id, CAST(len(list_distinct(coalesce(json_keys(m), []) || ['tier', 'note'])) AS BIGINT) AS fields, 'core' AS tier, CASE WHEN doc_id % 2 <> 0 THEN 'n' || doc_id % 3 END AS note, m->>'$.injected_count' AS injected_count FROM j""")
def patch_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two keys set in every row's metadata; all others stay."""
    raw = F.when(F.col("m").isNotNull(), F.col("metadata"))
    after = F.from_json(M.patched(raw, F.expr(_PATCH)), "map<string,string>")
    return rows(spark, sf_dir).select("doc_id", after.alias("n")).select("doc_id", F.size(F.map_keys("n")).cast("long").alias("fields"), *(F.element_at("n", c).alias(c) for c in ("tier", "note", "injected_count")))


@query(f"""WITH {_SMART}, g AS (SELECT doc_id, tier, state, CASE WHEN state = 'pending' AND ts < {NOW} - 2592000000 THEN 'archived' ELSE state END AS next_state, CASE WHEN tier = 'core' AND access_count < 3 THEN 'working' ELSE tier END AS next_tier FROM smart) SELECT doc_id, next_tier AS tier, next_state AS state, tier AS old_tier, state AS old_state FROM g WHERE next_tier <> tier OR next_state <> state""")
def governance_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only rows that a governance run changes, with what a rollback restores."""
    g = smart_rows(spark, sf_dir).select("doc_id", F.col("tier").alias("old_tier"), F.col("state").alias("old_state"), F.when((F.col("state") == "pending") & (F.col("ts") < NOW - 2592000000), "archived").otherwise(F.col("state")).alias("state"), F.when((F.col("tier") == "core") & (F.col("access_count") < 3), "working").otherwise(F.col("tier")).alias("tier"))
    return g.where("tier <> old_tier OR state <> old_state").select("doc_id", "tier", "state", "old_tier", "old_state")


@query(f"""WITH {_R}, r AS (SELECT doc_id, list_transform(range(doc_id % 20), lambda i: {{'type': 'supports', 'target': CAST(i AS VARCHAR)}}) AS old, CAST(doc_id % 30 AS VARCHAR) AS target FROM base)
 SELECT doc_id, CAST(least(16, CASE WHEN list_contains(old, {{'type': 'supports', 'target': target}}) THEN len(old) ELSE len(old) + 1 END) AS BIGINT) AS relations FROM r""")
def append_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One more relation, unless it is there; at most sixteen stay."""
    i = F.col("doc_id")
    old = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), i % 20 - 1)), lambda x: F.struct(F.lit("supports").alias("type"), x.cast("string").alias("target")))
    old = F.when(i % 20 > 0, old).otherwise(F.slice(old, 1, 0))
    return base(spark, sf_dir).select("doc_id", F.size(M.with_relation(old, "supports", (i % 30).cast("string"))).cast("long").alias("relations"))


@query(f"""WITH {_R}, a AS (SELECT doc_id, coalesce(TRY_CAST(coalesce(m->>'$.accessCount', m->>'$.access_count') AS DOUBLE), 0) AS n FROM j) SELECT doc_id, CAST(least(10000, greatest(0, floor(least(10000, greatest(0, floor(n))) + 3))) AS BIGINT) AS access_count FROM a""")
def bump_access_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three more accesses; counts stay within 0 and 10000, whichever way the key is written."""
    n = F.coalesce(M.number_of(F.col("m"), "$.accessCount"), M.number_of(F.col("m"), "$.access_count"), F.lit(0.0))
    clamp = lambda x: F.least(F.lit(10000.0), F.greatest(F.lit(0.0), F.floor(x).cast("double")))
    return rows(spark, sf_dir).select("doc_id", clamp(clamp(n) + 3).cast("long").alias("access_count"))


@query(f"WITH {_SMART} SELECT doc_id, CASE WHEN {_S('type')} IN ('memory-reflection', 'memory-reflection-event', 'memory-reflection-item') THEN 'reflection' ELSE category END || ':' || coalesce(scope, 'global') AS tag FROM smart")
def display_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = M.text_of(F.col("m"), "$.type").isin("memory-reflection", "memory-reflection-event", "memory-reflection-item")
    return rows(spark, sf_dir).select("doc_id", F.concat(F.when(kind, "reflection").otherwise(F.col("category")), F.lit(":"), F.coalesce("scope", F.lit("global"))).alias("tag"))


@query(f"""WITH {_R}, o AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'main' WHEN 3 THEN ' ops ' ELSE 'other' END AS owner FROM base) SELECT doc_id FROM o WHERE coalesce(trim(owner), '') IN ('', 'ops', 'main')""")
def owned_reflections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without owner, of the agent itself, or of the main agent."""
    owner = F.expr("CASE doc_id % 5 WHEN 1 THEN '  ' WHEN 2 THEN 'main' WHEN 3 THEN ' ops ' WHEN 4 THEN 'other' END")
    return base(spark, sf_dir).where(F.coalesce(F.trim(owner), F.lit("")).isin("", "ops", "main")).select("doc_id")



@query(f"""WITH {BASE_SQL}, old AS (SELECT 'L' || doc_id AS id, text, scope, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE importance END AS importance, ts AS created FROM base UNION ALL SELECT 'L' || item_id || 'b', text, NULL, NULL, NULL FROM benchmark)
 SELECT id, coalesce(scope, 'global') AS scope, coalesce(importance, 0.7) AS importance, coalesce(created, {NOW}) AS timestamp FROM old WHERE length(trim(text)) >= 2 AND text NOT IN (SELECT text FROM documents)""")
def migrate_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an older table that the new one lacks, with today's column names and defaults."""
    from recallium.sources.memories import table

    have = base(spark, sf_dir)
    old = have.select(F.concat(F.lit("L"), "id").alias("id"), "text", "scope", F.when(F.col("doc_id") % 4 != 0, F.col("importance")).alias("importance"), F.col("ts").alias("createdAt"))
    late = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("L"), F.col("item_id").cast("string"), F.lit("b")).alias("id"), "text", F.lit(None).cast("string").alias("scope"), F.lit(None).cast("double").alias("importance"), F.lit(None).cast("long").alias("createdAt"))
    rows = old.unionByName(late).where(F.length(F.trim("text")) >= 2).join(have.select("text").distinct(), "text", "left_anti")
    return rows.select("id", F.coalesce("scope", F.lit("global")).alias("scope"), F.coalesce("importance", F.lit(0.7)).alias("importance"), F.coalesce("createdAt", F.lit(NOW)).alias("timestamp"))


_KNOWN = [M.WRITTEN_AS.get(f, f) for f in FIELDS if f != "legacy"]


@query(f"""WITH {_SMART} SELECT doc_id, CAST(len(list_filter(coalesce(json_keys(m), CAST([] AS VARCHAR[])), lambda k: NOT list_contains({_KNOWN}, k))) + {' + '.join(f'CAST({f} IS NOT NULL AS INT)' for f in FIELDS if f != 'legacy')} AS BIGINT) AS fields,
 m->>'$.type' AS type, tier, access_count, confidence, fact_key, temporal_type, CAST(m->>'$.admission_control.evaluated_at' AS BIGINT) AS evaluated_at FROM smart""")
def built_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata built anew from what each row holds: known fields in normal form, unknown keys kept."""
    raw = F.when(F.col("m").isNotNull(), F.col("metadata"))
    new = rows(spark, sf_dir).select("doc_id", M.built(raw, F.lit("{}"), F.col("text"), F.col("category"), F.col("ts")).alias("built"))
    b = F.parse_json("built")
    get = lambda p, t: F.try_variant_get(b, p, t)
    return new.select(
        "doc_id", F.size(F.map_keys(get("$", "map<string,variant>"))).cast("long").alias("fields"), get("$.type", "string").alias("type"), get("$.tier", "string").alias("tier"), get("$.access_count", "long").alias("access_count"),
        get("$.confidence", "double").alias("confidence"), get("$.fact_key", "string").alias("fact_key"), get("$.memory_temporal_type", "string").alias("temporal_type"), get("$.admission_control.evaluated_at", "long").alias("evaluated_at"),
    )
