"""Flattening of nested run records and roll-ups over any set of keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions.columns import as_flag, joined_list, run_number
from seriesloom.model import METHODS, PROFILES
from seriesloom.operators.run_columns import AGGREGATES, COLUMNS

_KINDS = {"text": T.StringType(), "number": T.DoubleType(), "flag": T.StringType(), "check": T.StringType(), "list": T.ArrayType(T.StringType())}
#: Fields that are read besides those of COLUMNS.
_EXTRA = {"batch_id": "text", "generation_config.batch_id": "text", "structured_profile.profile_id": "text", "structured_profile.description": "text", "profile.id": "text", "profile.profile_id": "text", "profile.description": "text"}
FLAGS = [name for name, _, kind in COLUMNS if kind in ("flag", "check")]


def run_schema() -> T.StructType:
    """Superset of all run records; absent keys read as NULL. Flags are read as text and coerced."""
    tree: dict = {c: T.ArrayType(T.DoubleType()) for c in ("values_before_curation", "values_after_curation")}
    for path, kind in [*((path, kind) for _, path, kind in COLUMNS), *_EXTRA.items()]:
        *blocks, field = path.split(".")
        reduce(lambda at, b: at.setdefault(b, {}), blocks, tree).setdefault(field, _KINDS[kind])

    def struct(block: dict) -> T.StructType:
        return T.StructType([T.StructField(k, struct(v) if isinstance(v, dict) else v) for k, v in block.items()])

    return struct(tree)


def as_read(runs: DataFrame) -> DataFrame:
    """Run records in the schema in which they are read back."""
    return runs.select(F.from_json(F.to_json(F.struct("*")), run_schema()).alias("r")).select("r.*")


def flatten_runs(runs: DataFrame) -> DataFrame:
    """175 flat columns of run records as read (``source_file`` is taken if there); others go through ``as_read``."""
    out = [(F.col("source_file") if "source_file" in runs.columns else F.lit(None).cast("string")).alias("source_file")]
    out += [F.coalesce("batch_id", "generation_config.batch_id").alias("batch_id"), F.coalesce("structured_profile.profile_id", "profile.profile_id", "profile.id").alias("profile_id")]
    out += [F.coalesce("structured_profile.description", "profile.description").alias("profile_description"), run_number(F.col("experiment_id")).alias("run_id")]
    read = {"list": joined_list, "flag": as_flag, "check": lambda x: x.cast("boolean")}
    out += [read.get(kind, lambda x: x)(F.col(path)).alias(name) for name, path, kind in COLUMNS]
    return runs.select(*out)


# Which old temporal check each profile asks for.
_OLD_CHECKS = {"P1_20": ("no_strong_trend_ok",), "P2_28": ("no_strong_trend_ok", "weekly_seasonality_ok"), "P3_28": ("increasing_trend_ok", "weekly_seasonality_ok"), "P4_30": ("decreasing_trend_ok",), "P5_60": ("no_strong_trend_ok", "weekly_seasonality_ok"), "P6_60": ("increasing_trend_ok", "weekly_seasonality_ok")}
STRUCTURAL = ("length_ok", "timestamps_not_null", "values_not_null", "daily_frequency_ok", "range_ok", "values_numeric", "parse_success")


def derived_flags(flat: DataFrame) -> DataFrame:
    """Parse success, the old structural, temporal and final validity, and curation intensity.

    Missing checks count as failed before any rate is taken.
    """
    df = flat.withColumns({c: as_flag(F.col(c)) for c in FLAGS if c in flat.columns})
    df = df.withColumn("parse_success", F.col("profile_parse_success") | F.col("raw_json_valid") | F.col("parse_repaired"))
    df = df.withColumn("legacy_structural_valid", reduce(lambda a, b: a & b, [F.col(c) for c in STRUCTURAL]))
    temporal = F.lit(False)
    for pid, checks in _OLD_CHECKS.items():
        temporal = F.when(F.col("profile_id") == pid, reduce(lambda a, b: a & b, [F.col(c) for c in checks])).otherwise(temporal)
    df = df.withColumn("legacy_temporal_valid", temporal).withColumn("legacy_final_recomputed", F.col("legacy_structural_valid") & temporal)
    return df.withColumn("curation_intensity", F.coalesce("completed_points", F.lit(0)) + F.coalesce("truncated_points", F.lit(0)))


ROLLUPS = (("batch_id", "model", "profile_id", "method"), ("batch_id", "model", "method"), ("batch_id", "model"), ("batch_id", "profile_id", "method"))


def aggregates(available: list[str], spec=AGGREGATES) -> list[Column]:
    """The aggregate columns whose inputs exist; NULL status counts as no success."""
    out = []
    if "experiment_id" in available:
        out.append(F.count("experiment_id").alias("n_runs"))
    if "status" in available:
        out.append(F.avg(F.col("status").eqNullSafe(F.lit("success")).cast("double")).alias("success_rate"))
    for name, source, kind in spec:
        if source in available:
            x = F.col(source).cast("double")
            out.append((F.stddev_samp(x) if kind == "std" else F.avg(x)).alias(name))
    return out


def roll_up(flat: DataFrame, sets=ROLLUPS, spec=AGGREGATES) -> DataFrame:
    """All roll-ups in one pass: keys not in a set are NULL, ``level`` tells the sets apart."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    grouped = flat.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys])
    return grouped.agg(F.grouping_id(*keys).alias("level"), *aggregates(flat.columns, spec))


def report(rolled: DataFrame) -> DataFrame:
    return rolled.orderBy(F.desc_nulls_last("mean_llm_profile_compliance_score"), F.desc_nulls_last("strict_llm_valid_rate"), F.asc_nulls_last("length_curation_rate"))


def count_report(features: DataFrame) -> DataFrame:
    """Reference series of each profile."""
    return features.groupBy("profile_id").agg(F.count(F.lit(1)).alias("n_references")).orderBy("profile_id")


def select_runs(flat: DataFrame, profile_ids=None, methods=None, models=None, batch_id=None) -> DataFrame:
    """Runs of the given values; None keeps all."""
    for column, allowed in (("profile_id", profile_ids), ("method", methods), ("model", models), ("batch_id", [batch_id] if batch_id else None)):
        flat = flat.filter(F.col(column).isin(list(allowed))) if allowed else flat
    return flat


def report_runs(flat: DataFrame, profile_ids=None, methods=None, models=None, batch_id=None, all_methods: bool = False) -> DataFrame:
    """As ``select_runs``, but without a choice only official profiles and methods are kept (all methods on demand)."""
    methods = methods if methods or all_methods else [m[0] for m in METHODS]
    return select_runs(flat, profile_ids or [p[0] for p in PROFILES], methods, models, batch_id)


def previous_runs(runs: DataFrame, current: DataFrame, same_model: bool = True, same_batch: bool = True) -> DataFrame:
    """For each current run, successful runs of other methods with the same profile (and model and batch)."""
    on = (F.col("c.profile_id") == F.col("r.profile_id")) & (F.col("c.method") != F.col("r.method"))
    if same_model:
        on = on & (F.col("c.model") == F.col("r.model"))
    if same_batch:
        on = on & F.col("c.batch_id").eqNullSafe(F.col("r.batch_id"))
    usable = runs.filter((F.col("status") == "success") & F.col("experiment_id").isNotNull())
    return current.alias("c").join(usable.alias("r"), on).select(F.col("c.experiment_id").alias("for_experiment_id"), "r.*")


def previous_run_counts(runs: DataFrame, same_model: bool = True, same_batch: bool = True) -> DataFrame:
    """How many rows ``previous_runs`` has for each of all runs (no row if none), without its pairs.

    Successful runs are counted per method first; a run's own method is subtracted from its group's sum.
    """
    keys = ["profile_id", *["model"] * same_model, *["batch_id"] * same_batch]
    known = [F.col(k).isNotNull() for k in (*keys, "method") if k != "batch_id"]
    valid = runs.filter(reduce(lambda a, b: a & b, known))
    usable = ((F.col("status") == "success") & F.col("experiment_id").isNotNull()).cast("long")
    per = valid.groupBy(*keys, "method").agg(F.coalesce(F.sum(usable), F.lit(0)).alias("own"))
    others = per.withColumn("n", F.sum("own").over(Window.partitionBy(*keys)) - F.col("own")).filter("n > 0")
    on = reduce(lambda a, b: a & b, [F.col(f"c.{k}").eqNullSafe(F.col(f"o.{k}")) for k in (*keys, "method")])
    rows = valid.alias("c").join(others.alias("o"), on).select(F.col("c.experiment_id").alias("for_experiment_id"), "o.n")
    return rows.groupBy("for_experiment_id").agg(F.sum("n").alias("n"))
