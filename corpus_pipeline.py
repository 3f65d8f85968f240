"""Training-data pipeline over ``documents``: language, lines, near duplicates, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. The result of a stage is written as
Parquet to the shared folder and read again, so that no plan grows over stages and lost executors cost one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from siltworks.llm import bpe, language, leaks, lines, simhash
from siltworks.llm.common import small_batches, stored, table

RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; texts without a letter and undecided ones go."""
    return language.accepted(docs, language.fit(docs))


def first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that an earlier document (or line) has; n_chars follows the text."""
    left = lines.dedup_lines(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    small_batches(spark)
    return simhash.one_of_each(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    small_batches(spark)
    return leaks.clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding them gives the text back: doc_id, n_tokens, ids, whole."""
    small_batches(spark)
    return bpe.round_trip(docs, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", first_lines),
    ("near_dedup", one_of_each_group),
    ("decontamination", without_leaks),
    ("byte_bpe", token_ids),
]
# Walks, fingerprints and tokenizers cannot be written in SQL; tests/llm compares every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
