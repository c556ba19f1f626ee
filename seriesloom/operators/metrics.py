"""Scores of series against temporal profiles.

Everything works on a long table of points. What does not depend on a profile
is taken once for each series; what does depends on its seasonality and range
only, so each series is looked at once for each *variant* of these, not for each
profile. One exchange on the series serves all windows and aggregates, and
profiles are joined to the finished statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.columns import clip01, safe_corr

Z, MIN_RATIO, SOFT, HARD = 4.0, 0.15, 0.05, 0.25
KEY = ["series_id", "profile_id"]
#: What of a profile the statistics depend on; lag is NULL where a seasonal profile has no period.
VARIANT = ["seasonal", "lag", "value_min", "value_max"]
FLAT = ("flat", "none", "no_strong_trend")


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def with_variant(profiles: DataFrame) -> DataFrame:
    """Profiles with the VARIANT columns that they lack."""
    none = F.col("seasonality_expected") == "none"
    return profiles.withColumns({"seasonal": ~none & (F.coalesce(F.col("seasonality_period"), F.lit(0)) > 1), "lag": F.when(none, 7).otherwise(F.col("seasonality_period"))})


def residual_table(points: DataFrame) -> DataFrame:
    """Points (series_id, pos, value and VARIANT columns) with all windows over each series and variant.

    Invalid values (NULL, NaN) have no ``i`` and count in no statistic.
    """
    key = ["series_id", *VARIANT]
    w = Window.partitionBy(*key)
    df = points.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    df = df.withColumn("i", F.when(F.col("value").isNotNull(), F.count("value").over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("double"))
    df = df.withColumns({"n": F.count("value").over(w), "low": F.min("value").over(w), "high": F.max("value").over(w), "mean": F.avg("value").over(w), "sd": F.stddev_pop("value").over(w), "slope": F.regr_slope("value", "i").over(w), "icpt": F.regr_intercept("value", "i").over(w)})
    df = df.withColumn("range", F.col("high") - F.col("low"))
    df = df.withColumn("resid", F.when(F.col("n") < 3, F.col("value") - F.col("mean")).otherwise(F.col("value") - (F.col("slope") * F.col("i") + F.col("icpt"))))
    df = df.withColumn("phase", F.col("i") % F.col("lag"))
    df = df.withColumn("phase_mean", F.avg("resid").over(Window.partitionBy(*key, "phase")))
    flat = F.when(F.col("seasonal") & (F.col("n") >= 2 * F.col("lag")), F.col("resid") - F.col("phase_mean")).otherwise(F.col("resid"))
    df = df.withColumn("plain", flat)
    df = df.withColumn("med", F.median("plain").over(w))
    return df.withColumn("mad", F.median(F.abs(F.col("plain") - F.col("med"))).over(w))


def _with_trend_points(df: DataFrame) -> DataFrame:
    """Adds at, v and rank on one row of each point of the trend series (NULL elsewhere).

    Seasonal series are averaged over complete periods, if there are two; ranks
    of equal values are averaged. Values are added in order of position, as the
    last bit of a sum can part equal means.
    """
    key = ["series_id", *VARIANT]
    m = F.floor(F.col("n") / F.col("lag"))
    blocks = F.coalesce(F.col("seasonal") & (m >= 2), F.lit(False))
    at = F.when(blocks, F.when(F.col("i") < m * F.col("lag"), F.floor(F.col("i") / F.col("lag")))).otherwise(F.col("i")).cast("double")
    df = df.withColumn("at", at)
    block = Window.partitionBy(*key, "at").orderBy("pos")
    first = F.col("at").isNotNull() & (F.row_number().over(block) == 1)
    whole = block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumns({"v": F.avg("value").over(whole), "first": first})
    shown = Window.partitionBy(*key, "first")
    tied = F.count(F.lit(1)).over(Window.partitionBy(*key, "first", "v"))
    df = df.withColumn("rank", F.when(F.col("first"), F.rank().over(shown.orderBy("v")) + (tied - 1) / 2.0))
    return df.withColumns({c: F.when(F.col("first"), F.col(c)) for c in ("at", "v")}).drop("first")


def series_statistics(points: DataFrame) -> DataFrame:
    """One row of statistics for each series and variant."""
    df = _with_trend_points(residual_table(points))
    deviation = F.abs(F.col("plain") - F.col("med"))
    spike = (F.col("mad") > 0) & (0.6745 * deviation / F.when(F.col("mad") > 0, F.col("mad")) > Z) & (deviation >= MIN_RATIO * F.col("range"))
    per = df.groupBy("series_id", *VARIANT).agg(
        *[F.first(c).alias(c) for c in ("n", "low", "high", "mean", "sd", "slope", "range")],
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("value").between(F.col("value_min"), F.col("value_max"))).alias("outside"),
        (F.max("phase_mean") - F.min("phase_mean")).alias("swing"), F.count_if(spike).alias("spikes"), F.stddev_pop("plain").alias("plain_sd"),
        F.count("at").alias("m"), safe_corr(F.col("at"), F.col("rank")).alias("rho"), F.regr_slope("v", "at").alias("block_slope"), F.max_by("v", "at").alias("last"), F.min_by("v", "at").alias("first"),
    )
    strength = lambda slope, n: F.when((n < 2) | (F.col("range") == 0), 0.0).otherwise(_zero(F.abs(slope) * (n - 1) / F.when(F.col("range") != 0, F.col("range"))))
    long_enough = F.when(F.col("seasonal"), F.col("n") >= 2 * F.col("lag")).otherwise(F.col("n") >= 14)
    scale = F.greatest(F.col("range"), F.abs("mean"), F.lit(1e-8))
    two = F.signum(F.col("last") - F.col("first"))
    return per.select(
        "series_id", *VARIANT, "total", "outside", "n", "low", "high", "mean", "sd", F.coalesce("slope", F.lit(0.0)).alias("slope"), "range", "m",
        F.when(F.col("m") < 2, 0.0).when(F.col("m") == 2, two).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("rho")))).alias("rho"),
        strength(F.col("slope"), F.col("n")).alias("strength"), strength(F.col("block_slope"), F.col("m")).alias("trend_strength"),
        F.when(~long_enough | (F.col("lag") <= 1) | (F.col("range") == 0) | F.col("lag").isNull(), 0.0).otherwise(F.col("swing") / F.when(F.col("range") != 0, F.col("range"))).alias("amplitude"),
        F.when((F.col("n") < 5) | (F.col("range") == 0), 0).otherwise(F.col("spikes")).cast("long").alias("anomalies"),
        F.when(F.col("n") < 4, 0.0).otherwise(F.col("plain_sd") / scale).alias("noise"),
    )


def statistics_by_profile(points: DataFrame, profiles: DataFrame) -> DataFrame:
    """Statistics of every series under every profile, with the profile's columns.

    Where points have a ``profile_id``, each series meets that profile alone.
    """
    dim = with_variant(profiles)
    if "profile_id" in points.columns:
        keyed = points.select(*KEY, "pos", "value").join(F.broadcast(dim.select("profile_id", *VARIANT)), "profile_id").drop("profile_id")
        own = points.select(*KEY).distinct().join(F.broadcast(dim), "profile_id")
        same = [F.col(f"own.{c}").eqNullSafe(F.col(f"st.{c}")) for c in ("series_id", *VARIANT)]
        joined = own.alias("own").join(series_statistics(keyed).alias("st"), same, "left")
        return joined.select("own.*", *[f"st.{c}" for c in _STATS])
    variants = dim.select(*VARIANT).distinct()
    stats = series_statistics(points.select("series_id", "pos", "value").crossJoin(F.broadcast(variants)))
    same = [F.col(f"dim.{c}").eqNullSafe(F.col(f"st.{c}")) for c in VARIANT]
    return stats.alias("st").join(F.broadcast(dim).alias("dim"), same).select("st.series_id", "dim.*", *[f"st.{c}" for c in _STATS])


_STATS = ["total", "outside", "n", "low", "high", "mean", "sd", "slope", "range", "m", "rho", "strength", "trend_strength", "amplitude", "anomalies", "noise"]


def trend_score(expected: Column, rho: Column, strength: Column, threshold: Column, m: Column) -> Column:
    flat = expected.isin(*FLAT)
    up = F.when(expected == "increasing", F.greatest(F.lit(0.0), rho)).when(expected == "decreasing", F.greatest(F.lit(0.0), -rho)).otherwise(0.0)
    return F.when(m < 2, F.when(flat, 1.0).otherwise(0.0)).when(flat, 1.0 - F.least(strength / threshold, F.lit(1.0))).otherwise(up)


def seasonality_score(expected: Column, amplitude: Column, threshold: Column, period: Column, n: Column) -> Column:
    none = F.when(amplitude <= SOFT, 1.0).when(amplitude >= HARD, 0.0).otherwise(1.0 - (amplitude - SOFT) / (HARD - SOFT))
    some = F.when(period.isNull(), 0.0).otherwise(F.least(amplitude / threshold, F.lit(1.0)))
    return F.when(n < 4, F.when(expected == "none", 1.0).otherwise(0.0)).when(expected == "none", none).otherwise(some)


def anomaly_score(detected: Column, expected: Column, tolerance: Column) -> Column:
    d = F.abs(detected - expected)
    return F.when(d <= tolerance, 1.0).when(expected == 0, 1.0 - F.least(detected / 2.0, F.lit(1.0))).otherwise(1.0 - F.least(d / F.when(expected > 0, expected), F.lit(1.0)))


def noise_score(ratio: Column, low: Column, high: Column) -> Column:
    below = F.when(low == 0, 1.0).otherwise(1.0 - F.least((low - ratio) / F.when(low > 0, low), F.lit(1.0)))
    return F.when(low.isNull(), 0.0).when(ratio < low, below).when(ratio > high, 1.0 - F.least((ratio - high) / high, F.lit(1.0))).otherwise(1.0)


def length_score(generated: Column, expected: Column) -> Column:
    return F.when(expected <= 0, 0.0).otherwise(clip01(1.0 - F.abs(generated - expected) / F.when(expected > 0, expected)))


def profile_metrics(points: DataFrame, profiles: DataFrame, bands: DataFrame, parse_success: float | str = 1.0, timestamp_score: float | str = 1.0, facts: DataFrame | None = None) -> DataFrame:
    """All scores of every series against every profile, or against its own where points have a ``profile_id``.

    ``parse_success`` and ``timestamp_score`` are numbers, or columns of ``facts``
    (series_id, ...), which then also brings back series without any points.
    """
    c = F.col
    stats = statistics_by_profile(points, profiles)
    if facts is not None:
        known = facts.join(F.broadcast(with_variant(profiles)), "profile_id")
        stats = known.alias("f").join(stats.alias("s"), KEY, "left").select("f.*", *[f"s.{x}" for x in _STATS])
    stats = stats.join(F.broadcast(bands), "noise_expected", "left")
    given = lambda x: c(x).cast("double") if isinstance(x, str) else F.lit(float(x))
    n, total = F.coalesce(c("n"), F.lit(0)), F.coalesce(c("total"), F.lit(0))
    flat = c("trend_expected").isin(*FLAT)
    scored = stats.select(
        *KEY, total.alias("generated_length"), n.alias("numeric_length"), (total - n).alias("invalid_count"), F.coalesce(c("outside"), F.lit(0)).alias("out_of_range_count"),
        length_score(total, c("expected_length")).alias("length_score"), F.when(total > 0, n / total).otherwise(0.0).alias("numeric_validity_score"),
        F.when(n > 0, 1.0 - c("outside") / n).otherwise(0.0).alias("range_score"), given(timestamp_score).alias("timestamp_score"), given(parse_success).alias("parse_score"),
        F.when(flat, _zero(c("trend_strength"))).otherwise(_zero(c("rho"))).alias("trend_observed"),
        trend_score(c("trend_expected"), _zero(c("rho")), _zero(c("trend_strength")), c("flat_trend_threshold"), F.coalesce(c("m"), F.lit(0))).alias("trend_score"),
        _zero(c("amplitude")).alias("seasonality_strength"), seasonality_score(c("seasonality_expected"), _zero(c("amplitude")), c("seasonality_threshold"), c("seasonality_period"), n).alias("seasonality_score"),
        F.coalesce(c("anomalies"), F.lit(0)).alias("detected_anomalies"), anomaly_score(F.coalesce(c("anomalies"), F.lit(0)), c("expected_anomalies"), c("anomaly_tolerance")).alias("anomaly_score"),
        _zero(c("noise")).alias("noise_ratio"), noise_score(_zero(c("noise")), c("noise_low"), c("noise_high")).alias("noise_score"),
    )
    formal = ["parse_score", "length_score", "numeric_validity_score", "range_score", "timestamp_score"]
    temporal = ["trend_score", "seasonality_score", "anomaly_score", "noise_score"]
    mean = lambda names: sum((c(x) for x in names[1:]), c(names[0])) / float(len(names))
    out = scored.withColumn("formal_validity_score", mean(formal)).withColumn("temporal_profile_score", mean(temporal))
    worst = F.least(*[c(x) for x in temporal])
    valid = (c("parse_score") == 1) & (c("length_score") == 1) & (c("numeric_validity_score") == 1) & (c("range_score") >= 0.95) & (c("timestamp_score") >= 0.95) & (worst >= 0.60)
    return out.withColumn("profile_compliance_score", c("formal_validity_score") * c("temporal_profile_score")).withColumn("final_valid", valid).withColumn("all_formal_components_ok", F.least(*[c(x) for x in formal]) >= 0.95)


def lag_autocorrelation(points: DataFrame, lag: int) -> DataFrame:
    """series_id, correlation of values with those ``lag`` places on (0 if too short or constant)."""
    ahead = F.lag("value", lag).over(Window.partitionBy("series_id").orderBy("pos"))
    return points.withColumn("y", ahead).groupBy("series_id").agg(safe_corr(F.col("value"), F.col("y")).alias("autocorrelation"), F.count("value").alias("n"))


def weekly_autocorrelation(value: str = "value", ahead: str = "week_ahead") -> Column:
    """Aggregate: lag-7 correlation of 14 values or more; ``ahead`` holds the value seven places before."""
    return F.when(F.count(value) >= 14, safe_corr(F.col(value), F.col(ahead)))


def basic_metrics(points: DataFrame, threshold: float = 200.0) -> DataFrame:
    """Mean, deviation, extremes, slope, lag-7 correlation (14 values or more) and values at or over the threshold."""
    i = F.col("pos").cast("double")
    each = points.withColumn("week_ahead", F.lag("value", 7).over(Window.partitionBy("series_id").orderBy("pos")))
    return each.groupBy("series_id").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.regr_slope(F.col("value"), i).alias("trend_slope"),
        F.count_if(F.col("value") >= threshold).alias("anomaly_count"), weekly_autocorrelation().alias("weekly_autocorrelation"),
    )
