"""From raw documents to token digests: quality, near copies, repeats, benchmark leaks, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nocturne.llm import containment, quality, simhash, substring, tokens
from nocturne.llm.work import fresh, table


def _like(df: DataFrame, before: DataFrame) -> DataFrame:
    """``n_chars`` follows a changed text, where the table has that column."""
    if "n_chars" in before.columns:
        df = df.withColumn("n_chars", F.char_length("text").cast(before.schema["n_chars"].dataType))
    return df.select(*before.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed rules and the likelihood ratio against trusted text."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash links first, then five-word shingles, similarity 0.8."""
    return simhash.drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages of 20 words or more; documents of nothing else go.

    A document that had no word before stays as it is.
    """
    before = fresh(docs, "before")
    cut = substring.drop_repeats(docs.withColumn(before, F.col("text")))
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return _like(cut.where(~(blank & F.coalesce(F.col("text") != F.col(before), F.lit(False)))), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return containment.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document left."""
    return tokens.token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontaminate),
    ("byte_bpe", tokenize),
]

#: SimHash and byte-level BPE cannot be stated in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages in order, each one to the table its predecessor wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
