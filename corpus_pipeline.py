"""The corpus pipeline: documents without toxic ones, repeated lines, near copies and benchmark passages, mixed by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.decontaminate import drop_leaked
from tessera.llm.line_dedup import drop_repeated_lines
from tessera.llm.mixing import mix_documents
from tessera.llm.near_text import drop_near_duplicates
from tessera.llm.shared import id_fold, stash, table
from tessera.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go; labels of the held-out fold are never learned from.  Null texts score as empty ones."""
    return drop_toxic(docs, table(spark, sf_dir, "labels").where(id_fold("doc_id", 4) != 2).select("doc_id", "toxic"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines equal or near to an earlier one go, and documents left with none."""
    return drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group of near copies; null and empty texts are one group.

    SimHash links through BK-trees in shards, as in op10, and banded signatures for near copies beyond their radius propose; the sets of shingles decide.
    """
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts stay."""
    return drop_leaked(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with their text and columns, and how many it takes.  Null and empty texts have none and go."""
    return mix_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mixing),
]

#: Lexicons that are learned and XXH64 fingerprints have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; empty table: no rows.  Extra columns of documents come through, whatever their names."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
