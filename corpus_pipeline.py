"""From raw documents to token digests, in five stages. Each stage's result is written and read again."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathloom.llm.byte_bpe import encode
from pathloom.llm.common import staged, table
from pathloom.llm.decontamination import decontaminate
from pathloom.llm.line_dedup import drop_lines
from pathloom.llm.near_dedup import keep_first
from pathloom.llm.quality_rules import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs, digests=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: SQL has no decision list learning and no byte pair merges; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of the documents that all stages keep.

    Each stage states what it does with nulls, empty and long texts, ties and repeated rows.
    Columns of ``documents`` beyond doc_id, text and source go through the stages as they are,
    whatever their names; the last stage leaves them out. Empty tables give an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
