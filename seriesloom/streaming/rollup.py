"""Incremental roll-up of run records with Structured Streaming.

Each micro-batch adds mergeable sums per key to a table of the state; means and
deviations are read from the sums, so late records only add to them and nothing
is recomputed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def start(stream: DataFrame, keys: list[str], value: str, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append (keys, n, sum, sum of squares) of each micro-batch to ``path``; a repeated batch replaces itself."""

    def add(batch: DataFrame, number: int) -> None:
        x = F.col(value).cast("double")
        sums = batch.groupBy(*keys).agg(F.count(x).alias("n"), F.sum(x).alias("total"), F.sum(x * x).alias("squares"))
        sums.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """n, mean and sample deviation of each key from all batches so far."""
    per = spark.read.parquet(path).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])
    variance = (F.col("squares") - F.col("total") * F.col("total") / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0))
    return per.select(*keys, "n", (F.col("total") / F.col("n")).alias("mean"), F.when(F.col("n") > 1, F.sqrt(F.greatest(F.lit(0.0), variance))).alias("std"))


def windowed(stream: DataFrame, ts: str, key: str, value: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Sums by event-time window behind a watermark (time stamps without zone are cast, which watermarks need)."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
