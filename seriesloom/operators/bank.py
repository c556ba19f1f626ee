"""Synthetic reference series and their features.

Every draw is a function of (profile, series, position, seed), so the bank
doesn't depend on partitioning and any part of it can be made alone.
"""

from __future__ import annotations

import datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.functions.columns import normal, uniform
from seriesloom.model import PROFILE_SCHEMA, PROFILES
from seriesloom.operators.metrics import weekly_autocorrelation

# The week's pattern, and the noise's deviation by level.
WEEK = (100.0, 120.0, 140.0, 130.0, 110.0, 90.0, 80.0)
SIGMAS = {"low": (0.8, 2.0), "medium": (2.0, 5.0), "high": (5.0, 10.0)}
#: Values from which a point counts as an anomaly.
OVER = 200.0


def generate_bank(profiles: DataFrame, n: int = 30, seed: int = 42) -> DataFrame:
    """reference_id, profile_id, pos, ts, value."""
    ref = F.concat_ws("_", "profile_id", F.lit("ref"), F.lpad(F.col("k").cast("string"), 3, "0"))
    grid = profiles.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("reference_id", ref)
    u = lambda name, low, high, *more: low + (high - low) * uniform("reference_id", F.lit(name), *more, seed=seed)
    sigma = F.when(F.col("noise_expected") == "low", u("s", 0.8, 2.0)).when(F.col("noise_expected") == "high", u("s", 5.0, 10.0)).otherwise(u("s", 2.0, 5.0))
    points = grid.withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("expected_length") - 1)))
    noise = sigma * normal("reference_id", "pos", seed=seed)
    x = F.col("pos") / (F.col("expected_length") - 1)
    weekly = u("shift", -8.0, 8.0) + u("amp", 0.85, 1.15) * F.element_at(F.array(*map(F.lit, WEEK)), F.col("pos") % 7 + 1)
    rising = u("start", 80.0, 120.0) + u("rise", 40.0, 110.0) * x
    falling = u("start", 190.0, 240.0) * (1 - x) + u("end", 90.0, 130.0) * x
    is_weekly, trend = F.col("seasonality_expected") == "weekly", F.col("trend_expected")
    level = (
        F.when(is_weekly & (trend == "increasing"), weekly + u("gain", 5.0, 12.0) * F.floor(F.col("pos") / 7)).when(is_weekly, weekly + 1.5 * normal("reference_id", "pos", F.lit("w"), seed=seed))
        .when(trend == "increasing", rising).when(trend == "decreasing", falling).otherwise(u("level", 95.0, 110.0))
    )
    points = points.withColumn("value", level + noise)
    w = Window.partitionBy("reference_id")
    i = F.col("pos").cast("double")
    points = points.withColumns({"slope": F.regr_slope(F.col("value"), i).over(w), "span": F.max("value").over(w) - F.min("value").over(w)})
    strong = (trend == "flat") & (F.abs("slope") * (F.col("expected_length") - 1) / F.nullif(F.col("span"), F.lit(0.0)) > F.col("flat_trend_threshold"))
    points = points.withColumn("value", F.when(strong, F.col("value") - F.col("slope") * (i - (F.col("expected_length") - 1) / 2.0)).otherwise(F.col("value")))
    inner = (F.col("expected_length") <= 10) | F.col("pos").between(3, F.col("expected_length") - 4)
    turn = F.row_number().over(w.orderBy(F.when(inner, uniform("reference_id", "pos", F.lit("place"), seed=seed)).asc_nulls_last(), "pos"))
    hit = turn <= F.col("expected_anomalies")
    drop = (F.col("anomaly_type") == "drops") | ((F.col("anomaly_type") == "mixed") & (uniform("reference_id", "pos", F.lit("kind"), seed=seed) < 0.35))
    spike = F.greatest(200.0 + u("over", 30.0, 100.0, F.col("pos")), F.col("value") + u("up", 80.0, 150.0, F.col("pos")))
    points = points.withColumn("value", F.when(hit, F.when(drop, F.col("value") - u("down", 50.0, 100.0, F.col("pos"))).otherwise(spike)).otherwise(F.col("value")))
    value = F.bround(F.greatest(F.col("value_min"), F.least(F.col("value_max"), F.col("value"))), 2)
    return points.select("reference_id", "profile_id", "pos", F.date_add(F.col("start_date").cast("date"), F.col("pos")).alias("ts"), value.alias("value"))


def series_features(points: DataFrame, profiles: DataFrame, *keep: str) -> DataFrame:
    """series_id, keep and the FEATURES of series of any origin (series_id, profile_id, pos, value).

    The weekly correlation is NULL where the profile has no week, the anomaly
    count where it expects none.
    """
    i = F.col("pos").cast("double")
    each = points.filter(F.col("value").isNotNull()).withColumn("week_ahead", F.lag("value", 7).over(Window.partitionBy("series_id").orderBy("pos")))
    per = each.groupBy("series_id", "profile_id", *keep).agg(
        F.count("value").alias("length"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.regr_slope(F.col("value"), i).alias("trend_slope"), F.count_if(F.col("value") >= OVER).alias("over"), weekly_autocorrelation().alias("auto"),
    )
    dim = profiles.select("profile_id", (F.col("seasonality_expected") == "weekly").alias("weekly"), (F.coalesce("expected_anomalies", F.lit(0)) > 0).alias("point"))
    return per.join(F.broadcast(dim), "profile_id").select(
        "series_id", "profile_id", *keep, "length", "mean", "std", "min", "max", "trend_slope",
        F.when(F.col("weekly"), F.col("auto")).alias("weekly_autocorrelation"), F.when(F.col("point"), F.col("over").cast("double")).alias("anomaly_count"),
    )


def bank_features(series: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row of features for each reference series."""
    per = series_features(series.withColumnRenamed("reference_id", "series_id"), profiles).withColumnRenamed("series_id", "reference_id")
    dim = profiles.select("profile_id", F.col("description").alias("profile_description"), "trend_expected", "seasonality_expected", "expected_anomalies", F.col("noise_expected").alias("noise"))
    weekly, point = F.col("seasonality_expected") == "weekly", F.col("expected_anomalies") > 0
    return per.join(F.broadcast(dim), "profile_id").select(
        "reference_id", "profile_id", "profile_description", F.concat_ws("/", "profile_id", "reference_id").alias("path"), "length", "mean", "std", "min", "max", "trend_slope", "weekly_autocorrelation", "anomaly_count",
        F.when(F.col("trend_expected") == "flat", "none").otherwise(F.col("trend_expected")).alias("trend"), F.col("seasonality_expected").alias("seasonality"), F.when(point, "point").otherwise("none").alias("anomalies"), "noise",
        F.when(F.col("trend_expected") == "flat", "stable").otherwise(F.col("trend_expected")).alias("trend_attribute"), F.when(weekly, "weekly pattern").otherwise("no periodicity").alias("periodicity_attribute"),
        F.when(point, "point anomalies").otherwise("no local fluctuation").alias("local_fluctuation_attribute"), F.concat("noise", F.lit(" noise")).alias("noise_attribute"),
    )


def numpy_bank(spark: SparkSession, profiles: tuple = PROFILES, n: int = 30, seed: int = 42) -> DataFrame:
    """The bank from one NumPy generator, drawn in a fixed order on the driver: the published reference series.

    ``generate_bank`` makes the same kinds of series on any cluster; this one
    repeats given numbers. It has n series for each profile and nothing else, so
    it is small whatever the data.
    """
    rng, rows = np.random.default_rng(seed), []
    names = [x.split()[0] for x in PROFILE_SCHEMA.split(", ")]
    for p in (dict(zip(names, row, strict=True)) for row in profiles):
        size, weekly, rising = p["expected_length"], p["seasonality_expected"] == "weekly", p["trend_expected"] == "increasing"
        flat = p["trend_expected"] in ("flat", "no_strong_trend", "none")
        x = np.arange(size)
        for k in range(1, n + 1):
            if weekly:
                amplitude, shift = rng.uniform(0.85, 1.15), rng.uniform(-8, 8)
                gain = rng.uniform(5, 12) if rising else 0.0
            elif flat:
                level = rng.uniform(95, 110)
            else:
                begin = rng.uniform(80, 120) if rising else rng.uniform(190, 240)
                end = begin + rng.uniform(40, 110) if rising else rng.uniform(90, 130)
            sigma = rng.uniform(*SIGMAS.get(p["noise_expected"], SIGMAS["medium"]))
            if weekly:
                # a week's offset and the noise are drawn in turn for each point
                noise = rng.normal(0, sigma, size) if rising else rng.normal(0, np.tile([1.5, sigma], size)).reshape(size, 2).sum(axis=1)
                value = shift + amplitude * np.array(WEEK)[x % 7] + gain * (x // 7) + noise
            else:
                value = (level if flat else begin + (end - begin) * np.linspace(0, 1, size)) + rng.normal(0, sigma, size)
            if not rising and (weekly or flat):
                slope, span = np.polyfit(x, value, 1)[0], value.max() - value.min()
                if span and abs(slope) * (size - 1) / span > p["flat_trend_threshold"]:
                    value = value - slope * (x - x.mean())
            places = x if size <= 10 else x[3:-3]
            for at in rng.choice(places, size=min(p["expected_anomalies"], len(places)), replace=False) if p["expected_anomalies"] else []:
                down = p["anomaly_type"] == "drops" or (p["anomaly_type"] == "mixed" and rng.random() < 0.35)
                value[at] = max(p["value_min"], value[at] - rng.uniform(50, 100)) if down else max(200.0 + rng.uniform(30, 100), value[at] + rng.uniform(80, 150))
            value = np.round(np.clip(value, p["value_min"], p["value_max"]), 2)
            start = datetime.date.fromisoformat(p["start_date"])
            rows += [(f"{p['profile_id']}_ref_{k:03d}", p["profile_id"], i, start + datetime.timedelta(days=i), float(v)) for i, v in enumerate(value)]
    return spark.createDataFrame(rows, "reference_id string, profile_id string, pos int, ts date, value double")
