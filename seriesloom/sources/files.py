"""Readers and writers of series, features and run records. All paths are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions.columns import clean
from seriesloom.operators.rollup import run_schema

ROLLUP_KEYS = ("batch_id", "model", "profile_id", "method")

FEATURES = (
    "reference_id string, profile_id string, profile_description string, path string, length int, mean double, std double, min double, max double, trend_slope double, "
    "weekly_autocorrelation double, anomaly_count double, trend string, seasonality string, anomalies string, noise string, trend_attribute string, periodicity_attribute string, local_fluctuation_attribute string, noise_attribute string"
)


def read_features(spark: SparkSession, path: str, profile_id: str) -> DataFrame:
    """Features of one profile (Parquet by profile, or CSV); none is an error."""
    rows = spark.read.schema(FEATURES).csv(path, header=True) if path.endswith(".csv") else spark.read.parquet(path)
    rows = rows.filter(F.col("profile_id") == profile_id)
    if rows.isEmpty():
        raise ValueError(f"no reference features for {profile_id!r}")
    return rows


def write_bank(series: DataFrame, features: DataFrame, path: str, overwrite: bool = True) -> None:
    for name, df in (("series", series), ("features", features)):
        df.write.mode("overwrite" if overwrite else "ignore").partitionBy("profile_id").parquet(f"{path}/{name}")


def read_series_csv(spark: SparkSession, glob: str) -> DataFrame:
    """All two-column series files of a glob as one table of points; series_id is the file name."""
    raw = spark.read.schema("timestamp string, value string").csv(glob, header=True).select("*", "_metadata.file_name")
    name = F.regexp_replace("file_name", r"(_synthetic_series)?\.csv$", "")
    return raw.select(name.alias("series_id"), F.expr("try_cast(timestamp as timestamp_ntz)").alias("ts"), F.col("value").try_cast("double").alias("value"))


def write_series_csv(points: DataFrame, path: str, files: int = 0) -> None:
    """timestamp and value by series, in time order; ``files`` bounds the number of CSV files (0: as partitioned)."""
    rows = points.select("series_id", F.col("ts").alias("timestamp"), "value")
    rows = rows.repartition(files, "series_id") if files else rows.repartition("series_id")
    rows.sortWithinPartitions("series_id", "timestamp").write.csv(path, header=True)


def read_written_series(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_series_csv`` has written, as points."""
    rows = spark.read.schema("series_id string, timestamp string, value string").csv(path, header=True)
    return rows.select("series_id", F.expr("try_cast(timestamp as timestamp_ntz)").alias("ts"), F.col("value").try_cast("double").alias("value"))


def read_runs(spark: SparkSession, glob: str) -> DataFrame:
    """Run records, one JSON object a file; unreadable files are left out."""
    schema = run_schema().add("_corrupt_record", "string")
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(glob).select("*", F.col("_metadata.file_name").alias("source_file"))
    return rows.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def _plain(x: Column, kind: T.DataType) -> Column:
    """NaN and infinities as NULL at any depth of a value."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return clean(x)
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda v: _plain(v, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(x, lambda _, v: _plain(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(x.isNotNull(), F.struct(*[_plain(x[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return x


def write_runs(runs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines with explicit nulls; NaN and infinities become null, also inside structs, arrays and maps."""
    runs.select(*[_plain(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in runs.schema.fields]).write.mode(mode).option("ignoreNullFields", False).json(path)


def write_texts(rows: DataFrame, path: str, column: str, mode: str = "errorifexists") -> None:
    """Prompts or raw answers by experiment_id, as JSON lines (texts may hold any line breaks)."""
    rows.select("experiment_id", F.col(column).alias("text")).write.mode(mode).json(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("experiment_id string, text string").json(path)


def not_yet_run(planned: DataFrame, done: DataFrame, overwrite: bool = False) -> DataFrame:
    """Planned runs; those already done are an error unless they are to be overwritten."""
    if not overwrite and not planned.join(done, "experiment_id", "left_semi").isEmpty():
        raise FileExistsError("some planned runs have output already")
    return planned


def read_raw_outputs(spark: SparkSession, glob: str) -> DataFrame:
    rows = spark.read.text(glob, wholetext=True).select(F.col("value").alias("raw"), "_metadata.file_name")
    return rows.select(F.regexp_replace("file_name", r"(_raw_output)?\.txt$", "").alias("series_id"), "raw")


def write_rollups(rolled: DataFrame, path: str) -> None:
    """All levels in one pass, as sorted CSV files below ``level=...``."""
    keys = [c for c in rolled.columns if c in ROLLUP_KEYS]
    order = [F.asc_nulls_last(c) for c in keys]
    rolled.repartition("level").sortWithinPartitions("level", *order).write.mode("overwrite").partitionBy("level").csv(path, header=True)


def write_run_summary(flat: DataFrame, path: str) -> None:
    """The run-level summary: a row for each run, in the order of its keys."""
    keys = [c for c in (*ROLLUP_KEYS, "run_id") if c in flat.columns]
    flat.orderBy(*[F.asc_nulls_last(c) for c in keys]).write.mode("overwrite").csv(path, header=True)
