"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sortmill.llm import bpe, fingerprint, langid, linededup, minhash, mixing, quality, sharding, tokencount, toxicity
from sortmill.llm._work import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), copy="copy")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.duplicate_pairs(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.keep_good(table(spark, sf_dir, "documents")).select("doc_id", "lang", "source")


def op4_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents")).select("doc_id", "tokens", "n_tokens", "exact")


def op5_pack_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_chars")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_documents(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_bpe_encode": op4_bpe_encode,
    "op5_pack_shards": op5_pack_shards,
    "op6_toxicity": op6_toxicity,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_language_id": op10_language_id,
}

SQL: dict[str, str] = {
    "op1_mix_sources": mixing.SQL,
    "op3_quality_rules": quality.SQL,
    "op8_line_dedup": linededup.SQL,
}
