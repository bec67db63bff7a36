"""Corpus pipeline: quality rules, exact dedup, near-dedup, source mixing, packing.

Each stage works on all rows that the one before kept, and its decisions take effect; all
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import stage
from quern.llm.exact_dedup import drop_exact_duplicates
from quern.llm.minhash import drop_near_duplicates
from quern.llm.mixing import mix_documents
from quern.llm.packing import pack_documents
from quern.llm.quality import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules take for good ones."""
    return keep_good(spark, docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest id."""
    return drop_exact_duplicates(spark, docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    return drop_near_duplicates(spark, docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for."""
    return mix_documents(spark, docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with the bins that they share."""
    return pack_documents(spark, docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("minhash near-dedup", minhash_dedup),
    ("source mixing", source_mixing),
    ("best-fit packing", packing),
]

#: SQL can't express the near-duplicate groups and the packing at this size; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(spark, function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
