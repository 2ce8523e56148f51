"""Compaction, duplicates in a batch, support by a conversation, windows of messages, retries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallium.catalog import query
from recallium.functions import patterns as P
from recallium.operators import compaction, support
from recallium.sources.memories import DAY, NOW, table, with_vectors

DIM = 64

# Errors that may pass by themselves, and errors that will not.
TRANSIENT = [
    r"unexpected eof", r"\beconnreset\b", r"\beconnaborted\b", r"\betimedout\b", r"\bepipe\b", r"connection reset", r"socket hang up", r"socket (?:closed|disconnected)",
    r"connection (?:closed|aborted|dropped)", r"early close", r"stream (?:ended|closed) unexpectedly", r"temporar(?:y|ily).*unavailable", r"upstream.*unavailable", r"service unavailable", r"bad gateway",
    r"gateway timeout", r"\b(?:http|status)\s*(?:502|503|504)\b", r"\btimed out\b", r"\btimeout\b", r"\bund_err_(?:socket|headers_timeout|body_timeout)\b", r"network error", r"fetch failed",
]
FINAL = [
    r"\b401\b", r"\bunauthorized\b", r"invalid api key", r"invalid[_ -]?token", r"\bauth(?:entication)?_?unavailable\b", r"insufficient (?:credit|credits|balance)", r"\bbilling\b", r"\bquota exceeded\b",
    r"payment required", r"model .*not found", r"no such model", r"unknown model", r"context length", r"context window", r"request too large", r"payload too large", r"too many tokens", r"token limit",
    r"prompt too long", r"session expired", r"invalid session", r"refusal", r"content policy", r"safety policy", r"content filter", r"disallowed",
]


@query()
def greedy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all memories; greedy, so without SQL."""
    return compaction.greedy_clusters(with_vectors(spark, sf_dir), DIM)


@query()
def compaction_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that one run (at most 200 memories, a week old or more, the oldest first) writes in place of its clusters."""
    rows = with_vectors(spark, sf_dir).where(F.col("ts") < NOW - 7 * DAY).orderBy("ts", "doc_id").limit(200)
    return compaction.merged(compaction.greedy_clusters(rows, DIM).join(rows.drop("vector"), "doc_id"))


@query()
def batch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of five vectors."""
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") / 5).cast("long").alias("batch"), F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return compaction.batch_survivors(rows)


@query()
def confidence_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's latest message as a candidate, against the turns of the user."""
    turns = table(spark, sf_dir, "conversations")
    candidates = turns.groupBy("conv_id").agg(F.max_by("text", "turn").alias("candidate"))
    out = support.confidence_support(candidates, turns.where("role = 'user'"))
    return out.select("conv_id", *(F.round(c, 6).alias(c) for c in ("best", "coverage", "score")))


def message_windows(messages: DataFrame, most: int = 12_000, again: int = 10, windows: int = 200) -> DataFrame:
    """conv_id, chunk, first, last (message numbers from 1), chars. messages: conv_id, turn, role, text.

    A window ends before the message that would make it longer than `most`; the next one begins with its last `again` messages.
    A conversation gives `windows` at most (a limit of the feature). Only lengths are gathered, one conversation at a time."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        sizes = [n + len(f"[U{i}] \n") for i, n in enumerate(frame.sort_values("turn", kind="stable")["n"].tolist(), 1)]
        out, first, held = [], 1, 0
        for i, n in enumerate(sizes, 1):
            if held + n > most and i > first:
                out.append((first, i - 1, held))
                first = max(first, i - again)
                held = sum(sizes[first - 1 : i - 1])
            held += n
        out.append((first, len(sizes), held))
        return pd.DataFrame([(frame["conv_id"].iloc[0], k, *x) for k, x in enumerate(out[:windows])], columns=["conv_id", "chunk", "first", "last", "chars"])

    said = messages.where(F.col("role").isin("user", "assistant")).select("conv_id", "turn", F.length(P.strip(F.coalesce("text", F.lit("")))).alias("n")).where("n > 0")
    return said.groupBy("conv_id").applyInPandas(one, "conv_id long, chunk long, first long, last long, chars long")


@query(name="message_windows")
def _message_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return message_windows(table(spark, sf_dir, "conversations"))


_CJK, _LATIN = "len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]'))", "len(regexp_extract_all(text, '[A-Za-z]'))"


@query(f"SELECT doc_id, CASE WHEN {_CJK} > 0.8 * {_LATIN} THEN 'zh' WHEN {_LATIN} > 0.8 * {_CJK} THEN 'en' ELSE 'mixed' END AS lang FROM documents")
def session_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    cjk, latin = F.regexp_count("text", F.lit(r"[\x{4e00}-\x{9fff}]")), F.regexp_count("text", F.lit("[A-Za-z]"))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(cjk > 0.8 * latin, "zh").when(latin > 0.8 * cjk, "en").otherwise("mixed").alias("lang"))


def retry_reason(error, in_scope, retries, output):
    """Why a failed call is or is not tried again; only transient_upstream_failure is."""
    return (
        F.when(~in_scope, "not_reflection_scope").when(retries > 0, "retry_already_used").when(output > 0, "useful_output_present")
        .when(P.any_of(error, FINAL), "non_retry_error").when(P.any_of(error, TRANSIENT), "transient_upstream_failure").otherwise("non_transient_error")
    )


_ERRORS = ["read ECONNRESET", "HTTP 503 from upstream", "401 Unauthorized: timed out", "context length exceeded", "fetch failed", "no such file", "Service temporarily\nunavailable", "socket closed", "model x not found", "", "status 404", "prompt too long"]
_ERROR_SQL = "CASE event_id % 12 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_ERRORS)) + " END"


@query(
    f"""WITH e AS (SELECT event_id, user_id, {_ERROR_SQL} AS error FROM events) SELECT event_id, CASE WHEN user_id % 11 = 0 THEN 'not_reflection_scope' WHEN user_id % 7 = 0 THEN 'retry_already_used' WHEN user_id % 5 = 0 THEN 'useful_output_present'
 WHEN {P.any_sql('error', FINAL)} THEN 'non_retry_error' WHEN {P.any_sql('error', TRANSIENT)} THEN 'transient_upstream_failure' ELSE 'non_transient_error' END AS reason FROM e"""
)
def retry_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample errors spread over the events."""
    user = F.col("user_id")
    rows = table(spark, sf_dir, "events").withColumn("error", F.element_at(F.array(*map(F.lit, _ERRORS)), (F.col("event_id") % 12 + 1).cast("int")))
    return rows.select("event_id", retry_reason(F.col("error"), user % 11 != 0, (user % 7 == 0).cast("int"), (user % 5 == 0).cast("int")).alias("reason"))
