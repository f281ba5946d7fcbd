"""The corpus pipeline: quality rules, near-duplicate join, benchmark decontamination, PII redaction, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import decontam, jaccard, packing, pii, quality_rules
from lacuna.llm.common import made, materialize, remove, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return jaccard.keep_one(docs, jaccard.Join(percent=80, shingle=5))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a 10-word window of the benchmark."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), "documents")


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind, such as [EMAIL] or [SECRET]; n_chars follows the text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 tokens, with their ids."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", redaction), ("packing", packed)]
#: SQL can't express the later stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        since = made()
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        remove(spark, since, docs)  # what the stage wrote on its way
    return docs
