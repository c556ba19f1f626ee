"""A training corpus from ``documents``: five stages, each written and read again.

Each stage takes (spark, docs, sf_dir), works on all documents its predecessor
kept and returns the columns of ``documents``; the last returns the packed
pieces. Other tables are read from ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seriesloom.llm.common import staged
from seriesloom.llm.exact_dedup import drop_exact_copies
from seriesloom.llm.jaccard_join import one_of_each
from seriesloom.llm.mixing import mixed_documents
from seriesloom.llm.packing import pack_documents
from seriesloom.llm.toxicity import drop_toxic


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the limit stay."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return drop_exact_copies(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest id stays."""
    return one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source weights take them (up to twice)."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in which training sequence."""
    return pack_documents(docs)


STAGES = [("toxicity", remove_toxic), ("exact_dedup", remove_copies), ("ngram_jaccard", remove_near_copies), ("source_mix", mix), ("best_fit_packing", pack)]

#: The first stage is a trained network, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
