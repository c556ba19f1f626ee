"""Structural and temporal checks, quality scores and candidate choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.metrics import weekly_autocorrelation

CHECKS = ("length_ok", "timestamps_not_null", "values_not_null", "values_numeric", "range_ok", "daily_frequency_ok")
# The score and the failures of an attempt that gave no series.
FAILED_SCORE, FAILED_CHECKS = -9999.0, 999


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def validate(
    points: DataFrame, length: int | Column, low: float | Column, high: float | Column, trend: str | Column = "none", weekly: bool | Column = False, anomalies: int | Column | None = None,
    threshold: float | Column = 200.0, flat: float | Column = 0.30,
) -> DataFrame:
    """A row of checks per series, failed_checks in fixed order, and valid_series.

    Settings may be columns of the points, alike within a series; NULL
    ``anomalies`` means that their number is not checked. A slope of exactly 0
    counts as neither rising nor falling; a series of one point has no daily
    frequency.
    """
    spec = {"goal": length, "way": trend, "weekly": weekly, "wanted": F.lit(None).cast("int") if anomalies is None else anomalies, "flat": flat}
    w = Window.partitionBy("series_id").orderBy("pos")
    stamp = F.col("ts").cast("timestamp_ntz")
    each = points.withColumns({k: _column(v) for k, v in spec.items()} | {"in_range": F.col("value").between(_column(low), _column(high)), "over": F.col("value") >= _column(threshold)})
    each = each.withColumns({"step_ok": stamp - F.lag(stamp).over(w) == F.expr("INTERVAL '1' DAY"), "week_ahead": F.lag("value", 7).over(w)})
    i = F.col("pos").cast("double")
    per = each.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("length"), F.bool_and(F.col("ts").isNotNull()).alias("timestamps_not_null"), F.bool_and(F.col("value").isNotNull()).alias("values_not_null"),
        F.coalesce(F.bool_and("in_range"), F.lit(False)).alias("range_ok"), F.coalesce(F.bool_and("step_ok"), F.lit(False)).alias("daily_frequency_ok"),
        F.coalesce(F.regr_slope(F.col("value"), i), F.lit(0.0)).alias("trend_slope"), F.count_if("over").alias("anomaly_count"), weekly_autocorrelation().alias("weekly_autocorrelation"),
        *[F.first(k).alias(k) for k in spec],
    )
    c = F.col
    per = per.withColumn("length_ok", c("length") == c("goal")).withColumn("values_numeric", c("values_not_null"))
    extra = {
        "increasing_trend_ok": F.when(c("way") == "increasing", c("trend_slope") > 0), "decreasing_trend_ok": F.when(c("way") == "decreasing", c("trend_slope") < 0),
        "no_strong_trend_ok": F.when(c("way") == "none", F.abs("trend_slope") <= c("flat")), "weekly_seasonality_ok": F.when(c("weekly"), F.coalesce(c("weekly_autocorrelation") >= 0.7, F.lit(False))),
        "anomaly_count_ok": F.when(c("wanted").isNotNull(), c("anomaly_count") == c("wanted")),
    }
    per = per.withColumns(extra).drop(*spec)
    names = [*CHECKS, *extra]
    failed = F.filter(F.array(*[F.when(~c(k), F.lit(k)) for k in names]), lambda x: x.isNotNull())
    return per.withColumn("failed_checks", failed).withColumn("valid_series", F.size("failed_checks") == 0)


def quality_score(checks: DataFrame, trend: str | Column, weekly: bool | Column, anomalies: int | Column | None, compat: bool = True, status: Column | None = None) -> DataFrame:
    """A score for ranking candidates.

    ``compat`` counts only three plain checks for +5 each, as published scores
    do; else all six count. Rows whose ``status`` is not ``success`` get
    FAILED_SCORE and FAILED_CHECKS and count as invalid.
    """
    trend, weekly = _column(trend), _column(weekly)
    wanted = F.lit(None).cast("int") if anomalies is None else _column(anomalies)
    counted = ("length_ok", "values_not_null", "values_numeric") if compat else CHECKS
    sign = lambda c: F.when(F.col(c), 25.0).otherwise(-15.0)
    n = F.size("failed_checks")
    score = sum((F.when(F.col(c), 5.0).otherwise(0.0) for c in counted), F.lit(0.0)) + F.when(F.col("valid_series"), 100.0).otherwise(0.0)
    score = score + F.when(trend == "increasing", sign("increasing_trend_ok")).when(trend == "none", sign("no_strong_trend_ok") - F.least(F.abs("trend_slope"), F.lit(20.0))).otherwise(0.0)
    score = score + F.when(weekly, sign("weekly_seasonality_ok") + 5.0 * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce("weekly_autocorrelation", F.lit(0.0))))).otherwise(0.0)
    score = score + F.when(wanted.isNotNull(), sign("anomaly_count_ok") - 5.0 * F.abs(F.col("anomaly_count") - wanted)).otherwise(0.0) - 10.0 * n
    ok = F.lit(True) if status is None else F.coalesce(status == "success", F.lit(False))
    return checks.withColumns({
        "n_failed_checks": F.when(ok, n).otherwise(FAILED_CHECKS), "quality_score": F.when(ok, score).otherwise(FAILED_SCORE), "valid_series": ok & F.coalesce("valid_series", F.lit(False)),
    })


def best_candidate(candidates: DataFrame, *group: str) -> DataFrame:
    """Valid first, then the higher score, the fewer failures, the smaller candidate_id."""
    w = Window.partitionBy(*group).orderBy(F.col("valid_series").desc(), F.col("quality_score").desc(), F.col("n_failed_checks").asc(), F.col("candidate_id").asc())
    return candidates.withColumn("rank", F.row_number().over(w))


def candidate_summary(ranked: DataFrame, *group: str, status: str = "status") -> DataFrame:
    """n_candidates, n_successful_candidates, n_valid_candidates, valid_candidates_rate and all_failed of each group."""
    ok = F.coalesce(F.col(status) == "success", F.lit(False))
    per = ranked.groupBy(*group).agg(F.count(F.lit(1)).alias("n_candidates"), F.count_if(ok).alias("n_successful_candidates"), F.count_if(ok & F.col("valid_series")).alias("n_valid_candidates"))
    return per.withColumn("valid_candidates_rate", F.col("n_valid_candidates") / F.col("n_candidates")).withColumn("all_failed", F.col("n_successful_candidates") == 0)


def refine_or_keep(first: DataFrame, second: DataFrame) -> DataFrame:
    """attempt per series: the refined one if it is valid or fails strictly less; only invalid ones are refined."""
    cols = lambda df, p: df.select("series_id", *[F.col(c).alias(f"{p}_{c}") for c in ("valid_series", "n_failed_checks")])
    both = cols(first, "initial").join(cols(second, "refined"), "series_id", "left")
    better = ~F.col("initial_valid_series") & (F.col("refined_valid_series") | (F.col("refined_n_failed_checks") < F.col("initial_n_failed_checks")))
    return both.withColumn("attempt", F.when(F.coalesce(better, F.lit(False)), "refined").otherwise("initial"))
