"""A training corpus from ``documents``: quality rules, line dedup, near-dedup, decontamination, token ids.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as
Parquet and read again as the next stage's ``docs``. All but the last keep the
columns of ``documents``. Stages that change a text (quality rules remove
failing lines, line dedup removes aligned blocks) leave the other columns as
they are; ``n_chars`` stays the length of the source text.

Rows with nulls, empty texts, repeated rows and empty tables are handled as
the stages' operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sectorscope.llm import bpe, decontam, line_align, line_quality, simhash_trie
from sectorscope.session import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that fail the base rules or lose too much."""
    return line_quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has go; a document left without a word goes."""
    return line_align.remove_shared_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash_trie.keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontam.remove_documents(docs, benchmark)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the remaining texts: ``doc_id, n_tokens, ids, ids_sha256, decoded_sha256``."""
    path, pattern = bpe.public_file("byte_bpe_50k.tiktoken")
    return bpe.encode_documents(docs, path, pattern, output=("ids", "ids_sha256", "decoded_sha256")).select(
        "row.doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("byte_bpe", tokens),
]

#: The stages are not expressible in SQL (patience diff, XXH64 fingerprints, byte-level merges);
#: tests/llm/test_pipeline.py holds them against a plain Python version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
