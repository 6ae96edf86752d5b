"""The registered queries of this subpackage and their oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nocturne.session import work_folder

from . import containment, language, ledger, licenses, negatives, quality, sharding, simhash, substring, suffix, tokens, trie, warc
from .oracles import ORACLES  # noqa: F401  the entry reads it

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeated_strings(_table(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir)).drop("spans")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = containment.contained_items(_table(spark, sf_dir), _table(spark, sf_dir, "benchmark"))
    return pairs.select("doc_id", "item_id", "n_shingles", "n_shared")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir), _table(spark, sf_dir, "labels"), copies=True)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark, "warc")
    warc.write_archive(_table(spark, sf_dir, "pages"), path)
    records = warc.parse(warc.read_records(spark, path))
    verified = F.when(F.col("whole"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record of the archive is damaged")))
    return records.select("page_id", "payload_bytes", verified.alias("payload_digest"), "record_type", "refers_to")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_digests(_table(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(_table(spark, sf_dir))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal_digests(_table(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", label))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(*trie.with_shared_heads(trie.turns_of(_table(spark, sf_dir, "conversations"))))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = _table(spark, sf_dir), ledger.create(spark, work_folder(spark, "secret-ledger"))
    ledger.update(docs, path)
    return ledger.secret_digests(docs, path)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup, op2_suffix_array_dedup, op3_license_scan, op4_language_id, op5_benchmark_decontamination,
        op6_quality_rules, op7_warc, op8_byte_bpe, op9_sharding, op10_substring_dedup,
        op11_hard_negatives, op12_prefix_trie, op13_secret_scan,
    )
}
