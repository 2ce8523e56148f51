"""Text rules over all documents and a small table of literal samples, which shows what each pattern catches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallium.catalog import query
from recallium.functions import patterns as P
from recallium.operators import chunking
from recallium.operators.retrieval import expanded
from recallium.sources.memories import NOW, table

SAMPLES = [
    "I don't have any information", "I'm not sure about that", "do you remember my name?", "你还记得吗", "hello there", "HEARTBEAT ok", "query -> none", "Model switched to large", "ok", "thanks!", "123 456", "👍", "git push origin main please",
    "what did we decide last time about the config", "I prefer tabs over spaces", "we decided to switch to parquet", "My email is jo@example.org", "我my是 prefer", "喜欢 喝茶", "call me at +12345678901", "delete all memory entries now", "** bold **\n- list item here",
    "<b>markup I like</b>", "always use utc: times are fixed", "owner -> the data team", "deadline is tomorrow", "see you next week", "the day after tomorrow", "tonight we deploy", "who is the owner of billing?", "when did the outage happen", "how to install the api",
    "error: no such file /home/x/y 0xff 42", "token = \"abcdef123456\" and key", "Traceback (most recent call last)", "the service is called atlas", "[cron:1 job] run backup", "Sender (untrusted metadata): x", "System: [2024-01-01 10:00:00 GMT+1] started", "the container hung and the logging stopped", "配置 出错", "", "   ", "short", "yes.", "where?", "记住 this", "Authorization: Bearer abc.def-123==", "-----BEGIN RSA PRIVATE KEY-----\nMIIE\n-----END RSA PRIVATE KEY-----", "postgres://user:pass@host/db and C:\\Users\\x /Users/y sk-ant-aaaaaaaaaaaaaaaaaaaaaaaa github_pat_aaaaaaaaaaaaaaaaaaaaaaaa", "password='hunter22'; token=abcdefgh", "记忆 找不到", "status permission denied exit code 1",
]
_VALUES = ", ".join(f"({-1 - i}, '{s.replace(chr(39), chr(39) * 2)}')" for i, s in enumerate(SAMPLES))
TEXTS_SQL = f"texts AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {_VALUES}) AS s(doc_id, text)), t AS (SELECT doc_id, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM texts)"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = spark.createDataFrame([(-1 - i, s) for i, s in enumerate(SAMPLES)], "doc_id long, text string")
    return table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(samples)


def _rule(name: str, column, sql: str, extra: str = "") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return texts(spark, sf_dir).select("doc_id", column(F.col("text")).alias("value"))

    run.__doc__ = f"{name.replace('_', ' ')} of every text."
    query(f"WITH {TEXTS_SQL}{extra} SELECT doc_id, {sql} AS value FROM t", name)(run)


_SKIPPED = "regexp_replace(regexp_replace(s, '(?i)^\\[cron:[^\\]]+\\]\\s*', ''), '^\\s+|\\s+$', '', 'g')"
_rule("noise_filter", P.is_noise, f"length(s) < 5 OR {P.any_sql('s', P.DENIAL + P.META_QUESTION + P.BOILERPLATE + P.DIAGNOSTIC + P.PLATFORM)}")
_rule("envelope_noise", lambda t: P.any_of(t, P.ENVELOPE, "(?im)"), P.any_sql("text", P.ENVELOPE, "(?im)"))
_rule(
    "should_skip_retrieval", P.should_skip,
    f"CASE WHEN {P.any_sql(_SKIPPED, P.FORCE)} THEN false WHEN length({_SKIPPED}) < 5 THEN true WHEN {P.any_sql(_SKIPPED, P.SKIP)} THEN true ELSE length({_SKIPPED}) < CASE WHEN regexp_matches({_SKIPPED}, '{P.CJK}') THEN 6 ELSE 15 END AND NOT regexp_matches({_SKIPPED}, '[?？]') END",
)
_rule(
    "should_capture", P.should_capture,
    f"NOT (length(s) < CASE WHEN regexp_matches(s, '{P.CJK}') THEN 4 ELSE 10 END OR length(s) > 500 OR contains(s, '<relevant-memories>') OR (starts_with(s, '<') AND contains(s, '</')) OR (contains(s, '**') AND contains(s, chr(10) || '-')) OR len(regexp_extract_all(s, '[\\x{{1F300}}-\\x{{1F9FF}}]')) > 3) AND NOT {P.any_sql('s', P.EXCLUDE)} AND {P.any_sql('s', P.TRIGGERS)}",
)
_rule("intent_label", lambda t: P.first_of(t, [(n, p) for n, _, p in P.INTENTS], "none"), P.first_sql("text", [(n, p) for n, _, p in P.INTENTS], "'none'"))
_rule("intent_depth", lambda t: P.first_of(t, [(d, p) for _, d, p in P.INTENTS], "l0"), P.first_sql("text", [(d, p) for _, d, p in P.INTENTS], "'l0'"))
_rule("detect_category", lambda t: P.first_of(F.lower(t), P.CATEGORIES, "other"), P.first_sql("lower(text)", P.CATEGORIES, "'other'"))
_rule("infer_expiry", lambda t: P.first_of(t, [(NOW + h * 3600000, p) for p, h in P.EXPIRY_HOURS], None).cast("long"), f"CAST({P.first_sql('text', [(NOW + h * 3600000, p) for p, h in P.EXPIRY_HOURS], 'NULL')} AS BIGINT)")
_rule("error_signal", lambda t: P.any_of(F.lower(t), P.ERROR_SIGNALS, ""), P.any_sql("lower(text)", P.ERROR_SIGNALS, ""))
_rule("redact_secrets", P.redact, P.redact_sql("text"))
_SIGNATURE = "lower(" + P.redact_sql("text") + ")"
for _p, _r in ((r"[a-z]:\\[^ \n\r\t]+", "<path>"), (r"/[^ \n\r\t]+", "<path>"), (r"\b0x[0-9a-f]+\b", "<hex>"), (r"\b\d+\b", "<n>"), (r"\s+", " ")):
    _SIGNATURE = f"regexp_replace({_SIGNATURE}, '{_p}', '{_r}', 'g')"
_rule("error_signature", lambda t: F.substring(F.sha2(P.error_signature(t), 256), 1, 16), f"substr(sha256(substr(trim({_SIGNATURE}), 1, 240)), 1, 16)")
_TOPIC = "CASE WHEN regexp_extract(s, '^(.{1,120}?)[：:]', 1) <> '' THEN regexp_extract(s, '^(.{1,120}?)[：:]', 1) WHEN regexp_extract(s, '^(.{1,120}?)(?:\\s*->|\\s*=>)', 1) <> '' THEN regexp_extract(s, '^(.{1,120}?)(?:\\s*->|\\s*=>)', 1) ELSE s END"
_KEY = f"trim(regexp_replace(regexp_replace(lower({_TOPIC}), '\\s+', ' ', 'g'), '[。.!?]+$', ''))"
_rule("fact_key", lambda t: P.fact_key(F.lit("preferences"), t), f"CASE WHEN {_KEY} <> '' THEN 'preferences:' || {_KEY} END")
_rule("first_sentence", lambda t: F.regexp_extract(P.strip(t), r"^[^.!?。\n]{1,100}", 0), r"regexp_extract(s, '^[^.!?。\n]{1,100}', 0)")
_rule("tokenize_text", lambda t: F.array_join(F.regexp_extract_all(F.lower(t), F.lit(r"\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+"), F.lit(0)), " "), r"array_to_string(regexp_extract_all(regexp_replace(lower(text), '(\p{Han})', ' \1 ', 'g'), '[\p{L}\p{N}]+'), ' ')")
_rule("language_guess", lambda t: _language(F.regexp_count(t, F.lit(P.CJK)), F.regexp_count(t, F.lit("[A-Za-z]"))), f"CASE WHEN len(regexp_extract_all(text, '{P.CJK}')) + len(regexp_extract_all(text, '[A-Za-z]')) = 0 THEN 'unknown' WHEN len(regexp_extract_all(text, '{P.CJK}')) >= 0.8 * (len(regexp_extract_all(text, '{P.CJK}')) + len(regexp_extract_all(text, '[A-Za-z]'))) THEN 'cjk' WHEN len(regexp_extract_all(text, '[A-Za-z]')) >= 0.8 * (len(regexp_extract_all(text, '{P.CJK}')) + len(regexp_extract_all(text, '[A-Za-z]'))) THEN 'latin' ELSE 'mixed' END")


def _language(cjk, latin):
    both = cjk + latin
    return F.when(both == 0, "unknown").when(cjk >= 0.8 * both, "cjk").when(latin >= 0.8 * both, "latin").otherwise("mixed")


@query()
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five expansions of each text, in the order of the synonym groups; order decides, so without SQL."""
    return texts(spark, sf_dir).select("doc_id", expanded(F.col("text")).alias("expanded"))


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of at most 4000 characters and 50 lines with 200 of overlap, as trimmed code-point ranges."""
    return chunking.chunks(table(spark, sf_dir, "documents"))


@query()
def smart_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks sized by the limit of an embedding model and the share of CJK characters."""
    return chunking.chunks(table(spark, sf_dir, "documents"), chunking.settings(F.col("text"), "all-MiniLM-L6-v2"))


_SHARE = f"len(regexp_extract_all(coalesce(text, ''), '{chunking.CJK}')) / CAST(greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]'))) AS DOUBLE)"


@query(f"""WITH d AS (SELECT doc_id, CASE WHEN {_SHARE} > 0.3 THEN 2.5 ELSE 1.0 END AS divisor FROM documents)
 SELECT doc_id, CAST(greatest(200, floor(8192 * 0.7 / divisor)) AS INTEGER) AS most, CAST(floor(8192 * 0.05 / divisor) AS INTEGER) AS overlap, CAST(greatest(100, floor(8192 * 0.1 / divisor)) AS INTEGER) AS least FROM d""")
def chunk_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes for a model of 8192 tokens."""
    return table(spark, sf_dir, "documents").select("doc_id", chunking.settings(F.col("text"), None).alias("c")).select("doc_id", "c.most", "c.overlap", "c.least")
