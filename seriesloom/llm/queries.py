"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.chat_format import CHAT_SQL, chat_digests, chat_examples, with_probe
from seriesloom.llm.exact_dedup import EXACT_DEDUP_SQL, exact_dedup
from seriesloom.llm.jaccard_join import JACCARD_SQL, near_components
from seriesloom.llm.license_scan import scan_licenses
from seriesloom.llm.mixing import MIX_SQL, mix_sources
from seriesloom.llm.packing import pack_documents
from seriesloom.llm.ppm_score import ppm_scores
from seriesloom.llm.quality_rules import QUALITY_SQL, quality_rules
from seriesloom.llm.repeat_removal import repeated_passages
from seriesloom.llm.toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules(table(spark, sf_dir, "documents")).select(wanted)


def op4_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_scores(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).withColumn("spans", F.to_json("spans"))


def op6_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).drop("spans")


def op7_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_digests(chat_examples(with_probe(table(spark, sf_dir, "conversations"))))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_jaccard_join, op2_toxicity, op3_quality_rules, op4_ppm_score, op5_license_scan, op6_repeat_removal, op7_weighted_mix, op8_chat_format, op9_exact_dedup, op10_best_fit_packing]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_jaccard_join": JACCARD_SQL, "op3_quality_rules": QUALITY_SQL, "op7_weighted_mix": MIX_SQL, "op8_chat_format": CHAT_SQL, "op9_exact_dedup": EXACT_DEDUP_SQL}
