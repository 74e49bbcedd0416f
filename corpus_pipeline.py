"""The corpus pipeline: language, copies, near copies, benchmark passages, packing.

Each stage works on all its predecessor kept. Rows are told apart by ``doc_id``, which the near stage
expects to be unique and not null; null and empty texts go in the first stage, very long ones are read
whole, and an empty table gives an empty one. Every stage is written as Parquet on shared storage and
read from there by the next one. No SQL: languages are predicted by a trained model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from themeloom.functions.storage import stage
from themeloom.llm import decontamination, exact_dedup, language_id, packing, simhash_dedup
from themeloom.llm.shipping import ship

# The probability a text's language must have.
MIN_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the texts that have no language: those that are null, have no letter, or whose likeliest language is
    less likely than all others together."""
    ship(spark)
    return language_id.keep_known(docs, min_score=MIN_SCORE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first of equal texts."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first of each group of near-duplicates: fingerprints of four-word shingles that differ in four bits at most,
    through others too, as in ``op2_simhash_dedup``."""
    ship(spark)
    return simhash_dedup.drop_near_copies(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold an item of the benchmark."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal the documents into batches of alike lengths."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("exact", exact),
    ("near", near),
    ("decontaminate", clean),
    ("pack", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES:
        docs = stage(function(spark, docs, sf_dir))
    return docs
