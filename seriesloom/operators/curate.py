"""Building, cleaning, cutting and completing series, for all series at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.columns import clean, clip


def daily_series(events: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """series_id, pos, ts (day), value: daily sums in date order."""
    days = events.groupBy(F.col(key).cast("string").alias("series_id"), F.col(ts).cast("date").alias("ts")).agg(F.round(F.sum(value), 4).alias("value"))
    return with_positions(days)


def monthly_series(rows: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    months = rows.groupBy(F.col(key).cast("string").alias("series_id"), F.trunc(F.col(ts).cast("date"), "month").alias("ts")).agg(F.round(F.sum(value), 2).alias("value"))
    return with_positions(months)


def with_positions(points: DataFrame, *ties: str) -> DataFrame:
    w = Window.partitionBy("series_id").orderBy("ts", *ties)
    return points.select("series_id", (F.row_number().over(w) - 1).alias("pos"), "ts", "value", *ties)


def curate(points: DataFrame, low: Column, high: Column) -> DataFrame:
    """Drop points without time or value, keep the first (by src_pos) of each time, clip, renumber."""
    ok = points.withColumn("value", clean(F.col("value"))).dropna(subset=["ts", "value"])
    first = F.row_number().over(Window.partitionBy("series_id", "ts").orderBy("src_pos"))
    kept = ok.withColumn("rn", first).filter("rn = 1").withColumn("value", clip(F.col("value"), low, high))
    return with_positions(kept.select("series_id", "ts", "value"))


def truncate_to(points: DataFrame, length: int) -> DataFrame:
    return points.filter(F.col("pos") < length)


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


_SPEC = ("goal", "way", "weekly", "low", "high")


def specs_of(points: DataFrame, length: int | Column, trend: str | Column = "none", weekly: bool | Column = False, low: float | Column = 0.0, high: float | Column = 1000.0, start: str | Column = "2024-01-01") -> DataFrame:
    """series_id and what its completion needs; settings may be columns of the points, alike within a series."""
    spec = dict(zip((*_SPEC, "start"), (length, trend, weekly, low, high, start), strict=True))
    return points.groupBy("series_id").agg(*[F.first(_column(v)).alias(k) for k, v in spec.items()])


def complete(points: DataFrame, specs: DataFrame) -> DataFrame:
    """series_id, pos, value of exactly the points that bring each series of ``specs`` to its goal.

    Weekly series of 7 points or more go on from their phase means with a drift
    per week; others go on from the last value with a step (from 100, where there
    is none). Both are closed forms in the position, so there is no recursion.
    """
    per = points.groupBy("series_id").agg(F.count("value").alias("n"), F.max_by("value", "pos").alias("last"))
    per = specs.join(per, "series_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter(F.col("n") < F.col("goal"))
    by_week = F.col("weekly") & (F.col("n") >= 7)
    return _weekly(points, per.filter(by_week)).unionByName(_linear(points, per.filter(~by_week)))


def _signed(x: Column, fallback: float) -> Column:
    up = F.when(x > 0, x).when(x < 0, -x).otherwise(fallback)
    down = F.when(x < 0, x).when(x > 0, -x).otherwise(-fallback)
    return F.when(F.col("way") == "increasing", up).when(F.col("way") == "decreasing", down).otherwise(0.0)


def _weekly(points: DataFrame, short: DataFrame) -> DataFrame:
    points = points.select("series_id", "pos", "value")
    week = points.join(short.select("series_id", "n"), "series_id").filter(F.col("pos") < F.floor(F.col("n") / 7) * 7).groupBy("series_id", F.floor(F.col("pos") / 7).alias("w")).agg(F.avg("value").alias("v"))
    drift = week.groupBy("series_id").agg(F.try_divide(F.max_by("v", "w") - F.min_by("v", "w"), F.count("v") - 1).alias("drift"))
    phases = points.groupBy("series_id", (F.col("pos") % 7).alias("phase")).agg(F.avg("value").alias("base"), F.count("value").alias("seen"))
    new = short.join(drift, "series_id").select("series_id", "low", "high", _signed(F.coalesce("drift", F.lit(0.0)), 7.0).alias("drift"), F.explode(F.sequence(F.col("n"), F.col("goal") - 1)).alias("pos"))
    new = new.withColumn("phase", F.col("pos") % 7).join(phases, ["series_id", "phase"])
    extra = F.greatest(F.lit(0), F.floor(F.col("pos") / 7) - (F.col("seen") - 1))
    return new.select("series_id", F.col("pos").cast("int").alias("pos"), clip(F.col("base") + F.col("drift") * extra, F.col("low"), F.col("high")).alias("value"))


def _linear(points: DataFrame, per: DataFrame) -> DataFrame:
    tail = points.select("series_id", "pos", "value").join(per.select("series_id", "n"), "series_id").filter(F.col("pos") >= F.col("n") - 5)
    step = tail.groupBy("series_id").agg(F.try_divide(F.max_by("value", "pos") - F.min_by("value", "pos"), F.count("value") - 1).alias("step"))
    lone = F.when(F.col("n") < 2, F.when(F.col("way") == "decreasing", -1.0).otherwise(1.0))
    signed = F.coalesce(lone, _signed(F.coalesce("step", F.lit(0.0)), 1.0)).alias("step")
    new = per.join(step, "series_id", "left").select("series_id", "n", "last", "low", "high", signed, F.explode(F.sequence(F.col("n"), F.col("goal") - 1)).alias("pos"))
    value = F.coalesce("last", F.lit(100.0)) + F.col("step") * (F.col("pos") - F.col("n") + 1)
    return new.select("series_id", F.col("pos").cast("int").alias("pos"), clip(value, F.col("low"), F.col("high")).alias("value"))


def on_daily_grid(points: DataFrame, start: str | Column) -> DataFrame:
    return points.withColumn("ts", F.date_add(_column(start).cast("date"), F.col("pos")))


def enforce_length(points: DataFrame, specs: DataFrame) -> DataFrame:
    """Series longer than their goal are cut and keep their times; others get the daily grid, short ones after completion."""
    sized = points.join(specs.select("series_id", "goal", "start"), "series_id").withColumn("n", F.count("value").over(Window.partitionBy("series_id")))
    cut = sized.filter((F.col("n") > F.col("goal")) & (F.col("pos") < F.col("goal"))).select("series_id", "pos", F.col("ts").cast("date").alias("ts"), "value")
    rest = sized.filter(F.col("n") <= F.col("goal")).select("series_id", "pos", "value", "start")
    new = complete(points, specs).join(specs.select("series_id", "start"), "series_id")
    return cut.unionByName(on_daily_grid(rest.unionByName(new), F.col("start")).select("series_id", "pos", "ts", "value"))


def curation_change(points: DataFrame, length: int | Column) -> DataFrame:
    """series_id, completed_points, truncated_points, curation_change_rate."""
    per = points.withColumn("goal", _column(length)).groupBy("series_id").agg(F.count("value").alias("n"), F.first("goal").alias("goal"))
    zero = F.lit(0)
    per = per.select("series_id", F.greatest(zero, F.col("goal") - F.col("n")).alias("completed_points"), F.greatest(zero, F.col("n") - F.col("goal")).alias("truncated_points"), "goal")
    rate = F.when(F.col("goal") > 0, (F.col("completed_points") + F.col("truncated_points")) / F.col("goal").cast("double")).otherwise(0.0)
    return per.withColumn("curation_change_rate", rate).drop("goal")
