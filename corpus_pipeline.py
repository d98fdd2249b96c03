"""The corpus pipeline: quality rules, near-duplicates, benchmark passages, source mix, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
docs of the next one. All but the last return the columns of documents; rows that a stage rejects are gone for the
stages after it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskpanel.llm import decontaminate, mixing, order_minhash, quality_rules, sharding
from riskpanel.llm.common import dropped, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are depleted by frequent lines go; so do the frequent lines of all others.

    n_chars is that of the text which is left.
    """
    return quality_rules.clean_documents(docs, n_chars="n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of least id."""
    return order_minhash.filter_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.filter_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix."""
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each document: slots follow the order in which the mix was written, documents of a shared line gather.

    Documents that don't come from files have no such order; they are mixed and written first.
    """
    docs = docs if docs.inputFiles() else stored(source_mix(spark, docs, sf_dir), "source_mix")
    return sharding.shard(sharding.in_written_order(docs), links=sharding.line_links(docs), source="source", place="_place")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("shards", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: Order MinHash, banded alignment and label propagation can't be said in SQL; the tests hold run() against brute force.
ORACLE_SQL: str | None = None
