"""Dimensions: temporal profiles, generation methods and noise bands.

All operators take these as DataFrames, so thresholds are columns and callers
may bring their own rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROFILE_SCHEMA = (
    "profile_id string, description string, frequency string, start_date string, trend_expected string, seasonality_expected string, noise_expected string, anomaly_type string, "
    "expected_length int, expected_anomalies int, anomaly_tolerance int, seasonality_period int, value_min double, value_max double, flat_trend_threshold double, seasonality_threshold double, timestamp_required boolean"
)
POINT_SCHEMA = "series_id string, src_pos int, pos int, ts timestamp_ntz, value double"


def _profile(pid: str, length: int, trend: str, seasonal: str, anomalies: int, kind: str | None, tolerance: int, noise: str, threshold: float) -> tuple:
    text = f"{length} daily values, trend {trend}, seasonality {seasonal}, {anomalies} anomalies, {noise} noise"
    return (pid, text, "D", "2024-01-01", trend, seasonal, noise, kind, length, anomalies, tolerance, 7 if seasonal == "weekly" else None, 0.0, 1000.0, 0.30, threshold, False)


# The six official profiles.
PROFILES = (
    _profile("P1_20", 20, "flat", "none", 0, None, 0, "low", 0.30),
    _profile("P2_28", 28, "flat", "weekly", 0, None, 0, "medium", 0.50),
    _profile("P3_28", 28, "increasing", "weekly", 2, "spikes", 1, "medium", 0.50),
    _profile("P4_30", 30, "decreasing", "none", 0, None, 0, "medium", 0.30),
    _profile("P5_60", 60, "flat", "weekly", 0, None, 0, "medium", 0.50),
    _profile("P6_60", 60, "increasing", "weekly", 3, "mixed", 1, "high", 0.50),
)
# Noise level, lower and upper ratio.
NOISE_BANDS = (("low", 0.0, 0.08), ("medium", 0.03, 0.15), ("high", 0.12, 0.35))
# Method, family, whether its answer holds values only, whether it shows reference examples.
METHODS = (
    ("prompt_only", "zero_shot_prompting", False, False),
    ("constraint_guided", "constraint_based_prompting", False, False),
    ("canonical_few_shot", "few_shot_prompting", False, False),
    ("random_few_shot", "reference_bank_few_shot_prompting", True, True),
    ("harmonic_knn", "knn_guided_context_selection", True, True),
    ("tabgen_icl_residual", "residual_aware_context_selection", True, True),
    ("value_only_controlled_scale", "value_only_structured_generation", True, False),
    ("chatts_attribute_prompting", "attribute_conditioned_prompting", True, False),
    ("epic_grouped_attribute_few_shot", "grouped_attribute_few_shot_prompting", True, True),
    ("validator_feedback_refinement", "generate_validate_repair", True, False),
    ("cllm_generate_curate", "generate_and_curate", True, False),
)
ANOMALY_THRESHOLD = 200.0


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PROFILES), PROFILE_SCHEMA)


def methods(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(METHODS), "method string, method_family string, value_only boolean, uses_references boolean")


def noise_bands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NOISE_BANDS), "noise_expected string, noise_low double, noise_high double")


def _known(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    unknown = df.join(F.broadcast(dimension), key, "left_anti").select(key).limit(1).collect()
    if unknown:
        raise ValueError(f"unknown {key} {unknown[0][0]!r}")
    return df.join(F.broadcast(dimension), key)


def with_profile(df: DataFrame, dimension: DataFrame) -> DataFrame:
    """Join rows with their profile; an unknown profile_id is an error."""
    return _known(df, dimension, "profile_id")


def with_method(df: DataFrame, dimension: DataFrame) -> DataFrame:
    """Join rows with their method; an unknown method is an error."""
    return _known(df, dimension, "method")


def _older(frequencies: tuple[tuple[str, str], ...]) -> dict[str, Column]:
    """Columns that both older vocabularies have alike."""
    point = (F.coalesce("expected_anomalies", F.lit(0)) > 0) | F.coalesce(F.col("anomaly_type").isin("point", "spikes", "drops", "mixed"), F.lit(False))
    names = F.create_map(*[F.lit(x) for p in frequencies for x in p])
    return {
        "length": F.col("expected_length"), "frequency": F.coalesce(F.element_at(names, F.col("frequency")), F.col("frequency")),
        "trend": F.when(F.col("trend_expected").isin("flat", "no_strong_trend") | F.col("trend_expected").isNull(), "none").otherwise(F.col("trend_expected")),
        "seasonality": F.when(F.col("seasonality_expected").isin("false", "no") | F.col("seasonality_expected").isNull(), "none").otherwise(F.col("seasonality_expected")),
        "anomalies": F.when(point, "point").otherwise("none"), "noise": F.coalesce("noise_expected", F.lit("medium")), "anomaly_threshold": F.lit(ANOMALY_THRESHOLD), "normal_min": F.lit(80.0),
    }


def legacy_profile(dimension: DataFrame) -> DataFrame:
    """The older vocabulary, derived from the profile columns."""
    out = _older((("D", "daily"), ("H", "hourly"), ("W", "weekly"), ("M", "monthly")))
    return dimension.select(
        "profile_id", "description", *[v.alias(k) for k, v in out.items()],
        F.when(F.col("profile_id") == "P3_28", 180.0).when(F.col("profile_id") == "P6_60", 190.0).otherwise(130.0).alias("normal_max"),
        F.coalesce("flat_trend_threshold", F.lit(0.30)).alias("no_strong_trend_threshold"), "expected_anomalies", "seasonality_period", "value_min", "value_max", "start_date",
    )


def bank_profile(dimension: DataFrame) -> DataFrame:
    """The vocabulary in which reference series are made: one normal range for all profiles."""
    out = _older((("D", "daily"),)) | {"anomalies": F.when(F.coalesce("expected_anomalies", F.lit(0)) > 0, "point").otherwise("none")}
    return dimension.select(
        "profile_id", "description", *[v.alias(k) for k, v in out.items()], F.lit(130.0).alias("normal_max"), F.coalesce("flat_trend_threshold", F.lit(0.30)).alias("no_strong_trend_threshold"),
        "expected_anomalies", "anomaly_type", "seasonality_period", "value_min", "value_max", "start_date",
    )


def profile_agreement(structured: DataFrame, legacy: DataFrame) -> DataFrame:
    """profile_id and whether a given older row says what the structured one does; one without the other is NULL."""
    same = legacy_profile(structured).alias("s").join(legacy.alias("l"), "profile_id", "full")
    checks = [F.col(f"s.{c}").eqNullSafe(F.col(f"l.{c}")) for c in legacy.columns if c != "profile_id"]
    both = F.col("s.length").isNotNull() & F.col("l.length").isNotNull()
    return same.select("profile_id", F.when(both, reduce(lambda a, b: a & b, checks)).alias("agrees"))
