"""The corpus pipeline: stages over `documents`, each written as Parquet and reread as the next one's input.

quality_rules drops what the fences of the corpus reject; line_dedup removes passages that earlier documents hold;
near_dedup keeps one document of each group of near duplicates; mix_sources repeats documents to the target weights, in
shuffled order; bpe_encode adds tokens, n_tokens and exact. Null doc_ids, nulls in other columns, empty and long texts,
repeated rows, empty tables and further columns are treated as the operators' modules state, stage by stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sortmill.llm import bpe, linededup, minhash, mixing, quality
from sortmill.llm._work import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.remove_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("bpe_encode", bpe_encode),
]

#: Approximate search and tokenization are not SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
