"""A corpus pipeline of five stages: toxic documents go, one document of each near-duplicate class stays, repeated passages are
cut out, sources are mixed to target weights, and what is left is packed into sequences.

Each stage's result is written to the shared folder and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallium.llm import mixing, ngramjoin, packing, substrings, toxicity
from recallium.llm.common import Staged, documents


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a toxicity score of one half or more; learns from the labelled rows outside the held-out fold."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), toxicity.fold(5))
    return toxicity.reject(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each class of five-word Jaccard similarity 0.8 or more."""
    return ngramjoin.dedup(docs)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages out: runs of 50 words or more in which each byte is covered by a 200-byte string that starts in two places;
    documents stay, be they empty."""
    cut = substrings.remove(docs, substrings.PASSAGE, substrings.PASSAGE_WORDS)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as its source's rate and its hashed draw say."""
    return mixing.emit(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 4096 tokens; one row per piece."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("suffix_array_dedup", repeated_passage_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: Trained models and tokenizers cannot be said in SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        after = Staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            before.drop()
        docs, before = after.df, after
    return docs
