"""The thin queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallium.llm import audit, centroids, fuzzyhash, hmm, licenses, mixing, ngramjoin, packing, quality, reputation, sql, substrings, tokencount, toxicity
from recallium.llm.common import documents


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(documents(spark, sf_dir))


def op2_hidden_markov_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(documents(spark, sf_dir), hmm.fold(7, 2))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), _vocabulary("word_bpe_49k.json"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(documents(spark, sf_dir), _vocabulary("piece_bpe_32k.model"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), toxicity.fold(5)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out)
    return toxicity.score(docs, model, held_out)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.classes(documents(spark, sf_dir))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(documents(spark, sf_dir))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzyhash.fingerprints(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


#: The rules, the share of bad pages that no host may exceed, and how sure that must be.
RULES = [reputation.Rule("block", "net", "/"), reputation.Rule("allow", "example.net", "/en/"), reputation.Rule("block", "example.com", "/de/"), reputation.Rule("allow", "org", "/fr/")]
BAD_SHARE, CONFIDENCE = 0.5, 0.95


def op11_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document that the last number of its path names; it is bad when that one is labelled toxic or of low quality."""
    pages, labels = spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg((F.max(bad) == 1).alias("bad"))
    number = F.regexp_extract(reputation.host_and_path(F.col("url").cast("string"))[1], r"/([0-9]{1,18})(\.html|/)?$", 1)
    shown = pages.select("url", F.nullif(number, F.lit("")).cast("long").alias("doc_id"))
    return reputation.judge(pages, shown.join(marks, "doc_id", "left"), RULES, BAD_SHARE, CONFIDENCE)


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_array_dedup, op2_hidden_markov_scores, op3_best_fit_packing, op4_token_counts, op5_toxicity, op6_ngram_jaccard_join, op7_source_mixing, op8_document_fingerprints, op9_quality_rules, op10_license_scans, op11_url_reputation, op12_centroid_clustering, op13_filter_interaction_audit)}


def oracle_sql() -> dict[str, str]:
    return {
        op11_url_reputation.__name__: sql.url_reputation(RULES, BAD_SHARE, CONFIDENCE),
        op12_centroid_clustering.__name__: sql.centroid_clusters(),
        op13_filter_interaction_audit.__name__: sql.filter_interaction_audit(),
    }
