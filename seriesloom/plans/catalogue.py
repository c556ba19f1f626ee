"""The registered queries over the driver's tables and their DuckDB SQL.

Doubles are rounded to six digits on both sides, as engines add in other
orders; thresholds are compared before rounding. A value that lies on a rounding
step (a mean of prices) would fall to either side by the last bit of its sum, so
both sides multiply by 1 + 1e-11 first, which puts it on the same side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom import model
from seriesloom.functions import columns as c
from seriesloom.functions.parsing import parse_series
from seriesloom.operators import bank, curate, examples, metrics, prompts, rollup, select, validate, workflow
from seriesloom.operators.run_columns import AGGREGATES, COLUMNS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


NUDGE = 1.00000000001


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(F.col(n) * NUDGE, digits) + 0.0).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def query(sql: str | None = None, digits: int = 6):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, d: rounded(f(spark, d), digits)
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def T1(spark, d):  # noqa: N802
    return curate.daily_series(table(spark, d, "events"), "event_type", "ts", "value")


def T2(spark, d):  # noqa: N802
    return curate.daily_series(table(spark, d, "events"), "user_id", "ts", "value")


def T3(spark, d):  # noqa: N802
    return curate.monthly_series(table(spark, d, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice")


def T6(spark, d):  # noqa: N802
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    per = o.groupBy("c_custkey", "c_mktsegment").agg(F.count(F.lit(1)).cast("double").alias("n_orders"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.stddev_pop("o_totalprice"), 4).alias("std"))
    return per.select(F.col("c_custkey").alias("reference_id"), F.col("c_mktsegment").alias("grp"), "n_orders", "mean", "std")


def _series_sql(name: str, key: str, stamp: str, value: str, source: str, digits: int) -> str:
    return f"""{name} AS (SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS INT) AS pos, ts, value FROM
  (SELECT CAST({key} AS VARCHAR) AS series_id, {stamp} AS ts, round(sum({value}), {digits}) AS value FROM {source} GROUP BY 1, 2))"""


S1 = _series_sql("t1", "event_type", "CAST(ts AS DATE)", "value", "events", 4)
S2 = _series_sql("t2", "user_id", "CAST(ts AS DATE)", "value", "events", 4)
S3 = _series_sql("t3", "o_orderpriority", "CAST(date_trunc('month', o_orderdate) AS DATE)", "o_totalprice", "orders", 2)
S6 = """t6 AS (SELECT c_custkey AS reference_id, c_mktsegment AS grp, CAST(count(*) AS DOUBLE) AS n_orders, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def _values(rows) -> str:
    one = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)
    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


_names = [x.split()[0] for x in model.PROFILE_SCHEMA.split(", ")]
PROFILE_SQL = f"pr AS (SELECT * FROM (VALUES {_values(model.PROFILES)}) v({', '.join(_names)})), nb AS (SELECT * FROM (VALUES {_values(model.NOISE_BANDS)}) v(noise_level, noise_low, noise_high))"


def stats_sql(series: str = "t1") -> str:
    """CTEs up to ``k``, the statistics of each series under each profile."""
    w = "WINDOW w AS (PARTITION BY series_id, profile_id)"
    return f"""{PROFILE_SQL},
x AS (SELECT series_id, CAST(pos AS DOUBLE) AS pos, value, pr.* FROM {series} CROSS JOIN pr),
a AS (SELECT *, count(*) OVER w AS n, min(value) OVER w AS low, max(value) OVER w AS high, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS sd, regr_slope(value, pos) OVER w AS slope, regr_intercept(value, pos) OVER w AS icpt FROM x {w}),
b AS (SELECT *, high - low AS rng, CASE WHEN n < 3 THEN value - mean ELSE value - (slope * pos + icpt) END AS resid, seasonality_expected <> 'none' AND coalesce(seasonality_period, 0) > 1 AS seasonal,
  CASE WHEN seasonality_expected = 'none' THEN 7 ELSE seasonality_period END AS lg FROM a),
cc AS (SELECT *, avg(resid) OVER (PARTITION BY series_id, profile_id, pos % lg) AS pm FROM b),
dd AS (SELECT *, CASE WHEN seasonal AND n >= 2 * lg THEN resid - pm ELSE resid END AS plain FROM cc),
e AS (SELECT *, median(plain) OVER w AS med FROM dd {w}),
f AS (SELECT *, median(abs(plain - med)) OVER w AS mad FROM e {w}),
g AS (SELECT series_id, profile_id, any_value(n) AS n, any_value(low) AS low, any_value(high) AS high, any_value(mean) AS mean, any_value(sd) AS sd, any_value(slope) AS slope, any_value(rng) AS rng, any_value(lg) AS lg, any_value(seasonality_expected) AS se,
  max(pm) - min(pm) AS swing, count(*) FILTER (mad > 0 AND 0.6745::DOUBLE * abs(plain - med) / mad > 4 AND abs(plain - med) >= 0.15::DOUBLE * rng) AS spikes, stddev_pop(plain) AS psd FROM f GROUP BY 1, 2),
h AS (SELECT series_id, profile_id, CASE WHEN seasonal AND n // lg >= 2 THEN floor(pos / lg) ELSE pos END AS ps, avg(value) AS v FROM b WHERE NOT (seasonal AND n // lg >= 2) OR pos < (n // lg) * lg GROUP BY 1, 2, 3),
i AS (SELECT *, rank() OVER (PARTITION BY series_id, profile_id ORDER BY v) + (count(*) OVER (PARTITION BY series_id, profile_id, v) - 1) / 2.0::DOUBLE AS rk FROM h),
j AS (SELECT series_id, profile_id, count(*) AS m, CASE WHEN count(*) < 2 THEN 0 WHEN count(*) = 2 THEN sign(arg_max(v, ps) - arg_min(v, ps)) ELSE coalesce(covar_pop(ps, rk) / nullif(stddev_pop(ps) * stddev_pop(rk), 0), 0) END AS rho, regr_slope(v, ps) AS bs FROM i GROUP BY 1, 2),
k AS (SELECT g.*, j.m, j.rho, CASE WHEN n < 2 OR rng = 0 THEN 0 ELSE coalesce(abs(slope) * (n - 1) / nullif(rng, 0), 0) END AS strength, CASE WHEN m < 2 OR rng = 0 THEN 0 ELSE coalesce(abs(bs) * (m - 1) / nullif(rng, 0), 0) END AS tstrength,
  CASE WHEN (se = 'none' AND n < 14) OR (se <> 'none' AND n < 2 * lg) OR lg <= 1 OR rng = 0 THEN 0 ELSE swing / nullif(rng, 0) END AS amplitude,
  CASE WHEN n < 5 OR rng = 0 THEN 0 ELSE spikes END AS anomalies, CASE WHEN n < 4 THEN 0 ELSE psd / greatest(rng, abs(mean), 1e-8) END AS noise FROM g JOIN j USING (series_id, profile_id)),
sc AS (SELECT k.series_id, k.profile_id, k.n AS generated_length, k.n AS numeric_length, CAST(0 AS BIGINT) AS invalid_count, o.outside AS out_of_range_count,
  greatest(0, 1 - abs(k.n - expected_length) / CAST(expected_length AS DOUBLE)) AS length_score, 1.0::DOUBLE AS numeric_validity_score, 1 - o.outside / CAST(k.n AS DOUBLE) AS range_score, 1.0::DOUBLE AS timestamp_score, 1.0::DOUBLE AS parse_score,
  CASE WHEN trend_expected = 'flat' THEN tstrength ELSE rho END AS trend_observed,
  CASE WHEN m < 2 THEN CASE WHEN trend_expected = 'flat' THEN 1 ELSE 0 END WHEN trend_expected = 'flat' THEN 1 - least(tstrength / flat_trend_threshold, 1) WHEN trend_expected = 'increasing' THEN greatest(0, rho) ELSE greatest(0, -rho) END AS trend_score,
  amplitude AS seasonality_strength,
  CASE WHEN k.n < 4 THEN CASE WHEN se = 'none' THEN 1 ELSE 0 END WHEN se = 'none' THEN CASE WHEN amplitude <= 0.05::DOUBLE THEN 1 WHEN amplitude >= 0.25::DOUBLE THEN 0 ELSE 1 - (amplitude - 0.05::DOUBLE) / (0.25::DOUBLE - 0.05::DOUBLE) END
    ELSE least(amplitude / seasonality_threshold, 1) END AS seasonality_score,
  anomalies AS detected_anomalies,
  CASE WHEN abs(anomalies - expected_anomalies) <= anomaly_tolerance THEN 1 WHEN expected_anomalies = 0 THEN 1 - least(anomalies / 2.0::DOUBLE, 1) ELSE 1 - least(abs(anomalies - expected_anomalies) / CAST(expected_anomalies AS DOUBLE), 1) END AS anomaly_score,
  noise AS noise_ratio,
  CASE WHEN noise < noise_low THEN CASE WHEN noise_low = 0 THEN 1 ELSE 1 - least((noise_low - noise) / noise_low, 1) END WHEN noise > noise_high THEN 1 - least((noise - noise_high) / noise_high, 1) ELSE 1 END AS noise_score
  FROM k JOIN pr USING (profile_id) JOIN nb ON noise_level = noise_expected
  JOIN (SELECT series_id, profile_id, count(*) FILTER (value < value_min OR value > value_max) AS outside FROM x GROUP BY 1, 2) o ON o.series_id = k.series_id AND o.profile_id = k.profile_id)"""


def r(*names: str, digits: int = 6) -> str:
    pairs = [(n.partition("=")[0], n.partition("=")[2] or n) for n in names]
    return ", ".join(f"round(CAST({x} AS DOUBLE) * {NUDGE}::DOUBLE, {digits}) + 0 AS {n}" for n, x in pairs)


def _scores(spark, d, points=T1) -> DataFrame:
    return metrics.profile_metrics(points(spark, d), model.profiles(spark), model.noise_bands(spark))


_SCORES = "length_score numeric_validity_score range_score timestamp_score parse_score trend_observed trend_score seasonality_strength seasonality_score anomaly_score noise_ratio noise_score".split()
_FORMAL, _TEMPORAL = "(parse_score + length_score + numeric_validity_score + range_score + timestamp_score) / 5", "(trend_score + seasonality_score + anomaly_score + noise_score) / 4"


@query(f"""WITH {S1}, {stats_sql()}
SELECT series_id, profile_id, generated_length, numeric_length, invalid_count, out_of_range_count, CAST(detected_anomalies AS BIGINT) AS detected_anomalies, {r(*_SCORES, f"formal_validity_score={_FORMAL}", f"temporal_profile_score={_TEMPORAL}", f"profile_compliance_score=({_FORMAL}) * ({_TEMPORAL})")},
  parse_score = 1 AND length_score = 1 AND numeric_validity_score = 1 AND range_score >= 0.95 AND timestamp_score >= 0.95 AND least(trend_score, seasonality_score, anomaly_score, noise_score) >= 0.6 AS final_valid,
  least(parse_score, length_score, numeric_validity_score, range_score, timestamp_score) >= 0.95 AS all_formal_components_ok FROM sc""")
def profile_metrics_full(spark, d):
    return _scores(spark, d)


@query(f"WITH {S1} SELECT series_id, pos, ts, {r('value')} FROM t1")
def series_build(spark, d):
    return T1(spark, d)


@query(f"""WITH {S2}, y AS (SELECT *, lag(value, 7) OVER (PARTITION BY series_id ORDER BY pos) AS z FROM t2)
SELECT series_id, {r("mean=avg(value)", "std=stddev_pop(value)", "min=min(value)", "max=max(value)", "trend_slope=regr_slope(value, CAST(pos AS DOUBLE))")}, count(*) FILTER (value >= 200) AS anomaly_count,
  CASE WHEN count(*) >= 14 THEN {r("a=coalesce(covar_pop(value, z) / nullif(stddev_pop(value) FILTER (z IS NOT NULL) * stddev_pop(z), 0), 0)").removesuffix(" AS a")} END AS weekly_autocorrelation FROM y GROUP BY series_id""")
def series_basic_metrics(spark, d):
    return metrics.basic_metrics(T2(spark, d))


def _part(name: str, wanted: list[str], points, series_sql: str, series: str) -> None:
    sql = f"WITH {series_sql}, {stats_sql(series)} SELECT series_id, profile_id, {', '.join('CAST(detected_anomalies AS BIGINT) AS detected_anomalies' if x == 'detected_anomalies' else x if x.endswith('_count') or x.endswith('_length') else r(x) for x in wanted)} FROM sc"
    ORACLE[name] = sql
    QUERIES[name] = lambda spark, d: rounded(_scores(spark, d, points).select("series_id", "profile_id", *wanted))


_part("trend_score_flat", ["trend_observed", "trend_score"], T1, S1, "t1")
_part("trend_on_period_means", ["trend_observed", "trend_score"], T2, S2, "t2")
_part("seasonality_score", ["seasonality_strength", "seasonality_score"], T2, S2, "t2")
_part("anomaly_score", ["detected_anomalies", "anomaly_score"], T2, S2, "t2")
_part("noise_score", ["noise_ratio", "noise_score"], T2, S2, "t2")
_part("length_score", ["generated_length", "length_score"], T2, S2, "t2")
_part("range_diagnostics", ["out_of_range_count", "range_score"], T3, S3, "t3")
_part("numeric_validity", ["numeric_length", "invalid_count", "numeric_validity_score"], T2, S2, "t2")


def _stat(name: str, wanted: dict[str, str], points, series_sql: str, series: str) -> None:
    ORACLE[name] = f"WITH {series_sql}, {stats_sql(series)} SELECT series_id, profile_id, {', '.join(f'CAST({v} AS BIGINT) AS {k}' if k == 'anomalies' else r(f'{k}={v}') for k, v in wanted.items())} FROM k"
    QUERIES[name] = lambda spark, d: rounded(metrics.statistics_by_profile(points(spark, d), model.profiles(spark)).select("series_id", "profile_id", *wanted))


_stat("linear_trend_strength", {"slope": "slope", "strength": "strength"}, T3, S3, "t3")
_stat("spearman_trend", {"rho": "rho"}, T3, S3, "t3")
_stat("seasonal_amplitude", {"amplitude": "amplitude"}, T3, S3, "t3")
_stat("mad_anomalies", {"anomalies": "anomalies"}, T2, S2, "t2")
_stat("noise_ratio", {"noise": "noise"}, T3, S3, "t3")


@query(f"WITH {S1}, {stats_sql()} SELECT series_id, profile_id, CAST(pos AS BIGINT) AS pos, {r('resid', 'plain')} FROM f")
def deseasonalised_residuals(spark, d):
    dim = F.broadcast(metrics.with_variant(model.profiles(spark)))
    df = metrics.residual_table(T1(spark, d).crossJoin(F.broadcast(dim.select(*metrics.VARIANT).distinct())))
    same = [df[v].eqNullSafe(dim[v]) for v in metrics.VARIANT]
    return df.join(dim, same).select("series_id", "profile_id", F.col("i").cast("long").alias("pos"), "resid", "plain")


@query(f"WITH {S3} SELECT series_id, CAST(pos AS BIGINT) AS pos, {r('resid=value - (regr_slope(value, CAST(pos AS DOUBLE)) OVER w * pos + regr_intercept(value, CAST(pos AS DOUBLE)) OVER w)', digits=3)} FROM t3 WINDOW w AS (PARTITION BY series_id)", 3)
def detrend_residuals(spark, d):
    w, i = Window.partitionBy("series_id"), F.col("pos").cast("double")
    return T3(spark, d).select("series_id", F.col("pos").cast("long").alias("pos"), (F.col("value") - (F.regr_slope("value", i).over(w) * i + F.regr_intercept("value", i).over(w))).alias("resid"))


@query(f"WITH {S3}, z AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM t3) SELECT series_id, CAST(pos // 12 AS BIGINT) AS block, {r('mean=avg(value)')} FROM z WHERE pos < (n // 12) * 12 GROUP BY 1, 2")
def period_means(spark, d):
    n = F.count("value").over(Window.partitionBy("series_id"))
    rows = T3(spark, d).withColumn("n", n).filter(F.col("pos") < F.floor(F.col("n") / 12) * 12)
    return rows.groupBy("series_id", F.floor(F.col("pos") / 12).alias("block")).agg(F.avg("value").alias("mean"))


def _lag_sql(series: str, k: int) -> str:
    return f"SELECT series_id, {k} AS lag, {r('autocorrelation=coalesce(covar_pop(value, z) / nullif(stddev_pop(value) FILTER (z IS NOT NULL) * stddev_pop(z), 0), 0)')} FROM (SELECT *, lag(value, {k}) OVER (PARTITION BY series_id ORDER BY pos) AS z FROM {series}) GROUP BY 1"


@query(f"WITH {S1}, {S3} {_lag_sql('t1', 7)} UNION ALL {_lag_sql('t3', 12)}")
def lag_autocorrelation(spark, d):
    one = lambda points, k: metrics.lag_autocorrelation(points, k).select("series_id", F.lit(k).alias("lag"), "autocorrelation")
    return one(T1(spark, d), 7).unionByName(one(T3(spark, d), 12))


_CHECK_SQL = f"""{S2}, u AS (SELECT *, ts - lag(ts) OVER (PARTITION BY series_id ORDER BY pos) AS gap, lag(value, 7) OVER (PARTITION BY series_id ORDER BY pos) AS z FROM t2),
q AS (SELECT series_id, count(*) AS length, true AS timestamps_not_null, bool_and(value IS NOT NULL) AS values_not_null, bool_and(value BETWEEN 0 AND 1000) AS range_ok, coalesce(bool_and(gap = 1), false) AS daily_frequency_ok,
  coalesce(regr_slope(value, CAST(pos AS DOUBLE)), 0) AS trend_slope, count(*) FILTER (value >= 200) AS anomaly_count,
  CASE WHEN count(*) >= 14 THEN coalesce(covar_pop(value, z) / nullif(stddev_pop(value) FILTER (z IS NOT NULL) * stddev_pop(z), 0), 0) END AS auto FROM u GROUP BY 1),
v AS (SELECT *, length = 30 AS length_ok, abs(trend_slope) <= 0.3::DOUBLE AS flat_ok, coalesce(auto >= 0.7::DOUBLE, false) AS weekly_ok FROM q),
fl AS (SELECT *, list_filter([CASE WHEN NOT length_ok THEN 'length_ok' END, CASE WHEN NOT range_ok THEN 'range_ok' END, CASE WHEN NOT daily_frequency_ok THEN 'daily_frequency_ok' END,
  CASE WHEN NOT flat_ok THEN 'no_strong_trend_ok' END, CASE WHEN NOT weekly_ok THEN 'weekly_seasonality_ok' END], lambda x: x IS NOT NULL) AS failed FROM v)"""


def _checked(spark, d, points=T2, length=30):
    return validate.validate(points(spark, d), length, 0.0, 1000.0, "none", True)


@query(f"WITH {_CHECK_SQL} SELECT series_id, length, length_ok, range_ok, daily_frequency_ok, flat_ok AS no_strong_trend_ok, weekly_ok AS weekly_seasonality_ok, anomaly_count, {r('trend_slope')}, len(failed) = 0 AS valid_series FROM fl")
def legacy_validation(spark, d):
    return _checked(spark, d).select("series_id", "length", "length_ok", "range_ok", "daily_frequency_ok", "no_strong_trend_ok", "weekly_seasonality_ok", "anomaly_count", "trend_slope", "valid_series")


@query(f"WITH {_CHECK_SQL} SELECT series_id, array_to_string(failed, '|') AS failed_checks FROM fl")
def failed_checks(spark, d):
    return _checked(spark, d).select("series_id", F.array_join("failed_checks", "|").alias("failed_checks"))


_SCORE = "(CASE WHEN length_ok THEN 5 ELSE 0 END + 10 + CASE WHEN len(failed) = 0 THEN 100 ELSE 0 END + CASE WHEN flat_ok THEN 25 ELSE -15 END - least(abs(trend_slope), 20) + CASE WHEN weekly_ok THEN 25 ELSE -15 END + 5 * greatest(-1, least(1, coalesce(auto, 0))) - 10 * len(failed))"


@query(f"WITH {_CHECK_SQL} SELECT series_id, CAST(len(failed) AS INT) AS n_failed_checks, {r(f'quality_score={_SCORE}')} FROM fl")
def quality_score(spark, d):
    return validate.quality_score(_checked(spark, d), "none", True, None).select("series_id", "n_failed_checks", "quality_score")


@query(f"""WITH {_CHECK_SQL}, ca AS (SELECT CAST(series_id AS BIGINT) AS candidate_id, CAST(series_id AS BIGINT) % 10 AS grp, len(failed) = 0 AS ok, round({_SCORE}, 6) AS s, len(failed) AS nf FROM fl)
SELECT grp, candidate_id, CAST(row_number() OVER (PARTITION BY grp ORDER BY ok DESC, s DESC, nf, candidate_id) AS INT) AS rank FROM ca""")
def candidate_rank(spark, d):
    rows = validate.quality_score(_checked(spark, d), "none", True, None).withColumn("quality_score", F.round("quality_score", 6)).withColumn("candidate_id", F.col("series_id").cast("long"))
    return validate.best_candidate(rows.withColumn("grp", F.col("candidate_id") % 10), "grp").select("grp", "candidate_id", "rank")


@query(f"""WITH {_CHECK_SQL}, o AS (SELECT series_id, len(failed) AS a, len(failed) - CAST(NOT length_ok AS INT) + CAST(length <> 28 AS INT) AS b FROM fl)
SELECT series_id, CASE WHEN a > 0 AND (b = 0 OR b < a) THEN 'refined' ELSE 'initial' END AS attempt FROM o""")
def refine_or_keep(spark, d):
    first = validate.quality_score(_checked(spark, d), "none", True, None)
    second = validate.quality_score(_checked(spark, d, length=28), "none", True, None)
    return validate.refine_or_keep(first, second).select("series_id", "attempt")


@query(f"WITH {S2} SELECT series_id, pos, ts, {r('value=greatest(20, least(60, value))')} FROM t2")
def curate_dedupe_clip(spark, d):
    t = T2(spark, d).withColumn("src_pos", F.col("pos"))
    twice = t.unionByName(t.withColumn("src_pos", F.col("pos") + 1000).withColumn("value", F.lit(0.0)))
    return curate.curate(twice.select("series_id", "src_pos", "ts", "value"), F.lit(20.0), F.lit(60.0))


@query(f"WITH {S3} SELECT series_id, pos, {r('value')} FROM t3 WHERE pos < 60")
def truncate_to_length(spark, d):
    return curate.truncate_to(T3(spark, d), 60).select("series_id", "pos", "value")


@query(f"""WITH {S1}, t AS (SELECT * FROM t1 WHERE pos < 20), p AS (SELECT series_id, count(*) AS n FROM t GROUP BY 1),
wk AS (SELECT series_id, pos // 7 AS w, avg(value) AS v FROM t JOIN p USING (series_id) WHERE pos < (n // 7) * 7 GROUP BY 1, 2),
dr AS (SELECT series_id, coalesce((arg_max(v, w) - arg_min(v, w)) / nullif(count(*) - 1, 0), 0) AS x FROM wk GROUP BY 1),
ph AS (SELECT series_id, pos % 7 AS phase, avg(value) AS base, count(*) AS seen FROM t GROUP BY 1, 2)
SELECT p.series_id, CAST(g.pos AS INT) AS pos, {r("value=greatest(0, least(1000, base + CASE WHEN x > 0 THEN x WHEN x < 0 THEN -x ELSE 7 END * greatest(0, g.pos // 7 - (seen - 1))))")}
FROM p JOIN dr USING (series_id) CROSS JOIN (SELECT unnest(generate_series(0, 29)) AS pos) g JOIN ph ON ph.series_id = p.series_id AND ph.phase = g.pos % 7 WHERE g.pos >= p.n""")
def complete_weekly(spark, d):
    short = curate.truncate_to(T1(spark, d), 20)
    return curate.complete(short, curate.specs_of(short, 30, "increasing", True))


@query(f"""WITH {S1}, t AS (SELECT * FROM t1 WHERE pos < 20), p AS (SELECT series_id, count(*) AS n, arg_max(value, pos) AS la FROM t GROUP BY 1),
st AS (SELECT series_id, coalesce((arg_max(value, pos) - arg_min(value, pos)) / nullif(count(*) - 1, 0), 0) AS x FROM t JOIN p USING (series_id) WHERE pos >= n - 5 GROUP BY 1)
SELECT series_id, CAST(g.pos AS INT) AS pos, {r("value=greatest(0, least(1000, la + CASE WHEN x < 0 THEN x WHEN x > 0 THEN -x ELSE -1 END * (g.pos - n + 1)))")}
FROM p JOIN st USING (series_id) CROSS JOIN (SELECT unnest(generate_series(0, 29)) AS pos) g WHERE g.pos >= n""")
def complete_linear(spark, d):
    short = curate.truncate_to(T1(spark, d), 20)
    return curate.complete(short, curate.specs_of(short, 30, "decreasing", False))


@query(f"WITH {S2} SELECT series_id, greatest(0, 28 - count(*)) AS completed_points, greatest(0, count(*) - 28) AS truncated_points, {r('curation_change_rate=abs(28 - count(*)) / 28.0::DOUBLE')} FROM t2 GROUP BY 1")
def curation_change_rate(spark, d):
    return curate.curation_change(T2(spark, d), 28)


@query(f"""WITH {S6}, m AS (SELECT median(n_orders) AS a, median(mean) AS b, median(std) AS c, coalesce(nullif(stddev_pop(n_orders), 0), 1) AS x, coalesce(nullif(stddev_pop(mean), 0), 1) AS y, coalesce(nullif(stddev_pop(std), 0), 1) AS z FROM t6),
q AS (SELECT reference_id, (n_orders - a) / x AS u, (mean - b) / y AS v, (std - c) / z AS w FROM t6, m), o AS (SELECT * FROM q WHERE reference_id = 1)
SELECT q.reference_id, {r("distance=sqrt((q.u - o.u) ** 2 + (q.v - o.v) ** 2 + (q.w - o.w) ** 2)")} FROM q, o WHERE q.reference_id <> 1 ORDER BY sqrt((q.u - o.u) ** 2 + (q.v - o.v) ** 2 + (q.w - o.w) ** 2), q.reference_id LIMIT 10""")
def knn_neighbors(spark, d):
    return select.nearest(T6(spark, d), ["n_orders", "mean", "std"], 1, 10)


def _js_sql(group: str, src: str) -> str:
    return f"""ed AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, least(10, greatest(2, count(DISTINCT l_quantity))) AS kk FROM lineitem),
rf AS (SELECT least(kk - 1, CAST(floor((l_quantity - lo) / (hi - lo) * kk) AS BIGINT)) AS bin, count(*) AS r FROM lineitem, ed GROUP BY 1),
cd AS (SELECT {group} AS g, least(kk - 1, CAST(floor((l_quantity - lo) / (hi - lo) * kk) AS BIGINT)) AS bin, count(*) AS c FROM {src}, ed GROUP BY 1, 2),
gr AS (SELECT gg.g, b.bin, coalesce(r, 0) + 1.0::DOUBLE AS rr, coalesce(c, 0) + 1.0::DOUBLE AS qq FROM (SELECT DISTINCT g FROM cd) gg CROSS JOIN (SELECT unnest(generate_series(0, (SELECT kk - 1 FROM ed))) AS bin) b LEFT JOIN rf ON rf.bin = b.bin LEFT JOIN cd ON cd.g = gg.g AND cd.bin = b.bin),
pq AS (SELECT g, rr / sum(rr) OVER (PARTITION BY g) AS p, qq / sum(qq) OVER (PARTITION BY g) AS q FROM gr),
js AS (SELECT g, sqrt(greatest(0, sum(p * ln(p / ((p + q) / 2)) / 2 + q * ln(q / ((p + q) / 2)) / 2))) AS dist FROM pq GROUP BY g)"""


@query(f"WITH {_js_sql('l_returnflag', 'lineitem')} SELECT g AS l_returnflag, {r('distance=dist')} FROM js")
def js_distance(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_quantity")
    return select.js_distance(rows, rows, "l_quantity", ["l_returnflag"])


@query(f"WITH {_js_sql('l_linenumber', 'lineitem')} SELECT g AS candidate, {r('distance=dist')} FROM js ORDER BY dist, g LIMIT 1")
def subset_min_distance(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("candidate"), "l_quantity")
    return select.closest_subset(rows, rows, ["l_quantity"])


@query(f"""WITH {S6}, cu AS (SELECT list_distinct(quantile_cont(mean, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS cuts FROM t6)
SELECT reference_id, CAST(greatest(0, len(list_filter(cuts, lambda x: x < mean)) - 1) AS INT) AS bin FROM t6, cu""")
def quantile_bins(spark, d):
    return select.quantile_bins(T6(spark, d), "mean").select("reference_id", "bin")


_ROLES = [("steepest", "-mean"), ("calmest", "std"), ("typical", "abs(n_orders - 10)"), ("busiest", "-n_orders")]


@query(f"""WITH {S6}, r1 AS (SELECT reference_id FROM t6 ORDER BY -mean, reference_id LIMIT 1), r2 AS (SELECT reference_id FROM t6 WHERE reference_id NOT IN (SELECT * FROM r1) ORDER BY std, reference_id LIMIT 1),
r3 AS (SELECT reference_id FROM t6 WHERE reference_id NOT IN (SELECT * FROM r1 UNION ALL SELECT * FROM r2) ORDER BY abs(n_orders - 10), reference_id LIMIT 1),
r4 AS (SELECT reference_id FROM t6 WHERE reference_id NOT IN (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3) ORDER BY -n_orders, reference_id LIMIT 1)
SELECT 'steepest' AS role, * FROM r1 UNION ALL SELECT 'calmest', * FROM r2 UNION ALL SELECT 'typical', * FROM r3 UNION ALL SELECT 'busiest', * FROM r4""")
def role_topk(spark, d):
    return select.by_roles(T6(spark, d), _ROLES)


def u_sql(*keys: str, seed: str = "42") -> str:
    """The hash-based uniform of ``functions.columns`` in SQL."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(f'CAST({k} AS VARCHAR)' for k in (*keys, seed))})), 1, 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE)"


def normal_sql(*keys: str) -> str:
    return f"(sqrt(-2 * ln(1 - {u_sql(*keys, repr('u'))})) * cos(2 * 3.141592653589793::DOUBLE * {u_sql(*keys, repr('v'))}))"


@query(f"WITH {S6} SELECT reference_id, grp, {r('n_orders', 'mean', 'std')} FROM t6 ORDER BY {u_sql('reference_id', seed='43')}, reference_id LIMIT 25")
def seeded_sample(spark, d):
    return select.seeded_sample(T6(spark, d), 25, 43)


def _runs(spark, d) -> DataFrame:
    """orders with their customers as run records: model, method, profile and scores."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    status = F.when(F.col("o_orderkey") % 11 == 0, None).when(F.col("o_orderstatus") == "F", "failed").otherwise("success")
    return o.select(
        F.concat_ws("_", "c_mktsegment", "o_orderstatus", F.concat(F.lit("run"), F.col("o_orderkey").cast("string"))).alias("experiment_id"), status.alias("status"),
        F.when(F.col("o_orderkey") % 7 != 0, F.lit("b1")).alias("batch_id"), F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("method"), F.col("c_mktsegment").alias("profile_id"),
        F.when(F.col("o_orderkey") % 3 == 0, "yes").when(F.col("o_orderkey") % 3 == 1, "no").alias("strict_llm_valid"), F.round(F.col("o_totalprice") / 1000, 6).alias("llm_profile_compliance_score"), F.col("c_acctbal").alias("elapsed_time_seconds"),
    )


_RUNS = """rn AS (SELECT concat_ws('_', c_mktsegment, o_orderstatus, 'run' || o_orderkey) AS experiment_id, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'success' END AS status,
  CASE WHEN o_orderkey % 7 <> 0 THEN 'b1' END AS batch_id, o_orderpriority AS model, o_orderstatus AS method, c_mktsegment AS profile_id, o_orderkey % 3 = 0 AS strict_llm_valid, round(o_totalprice / 1000, 6) AS llm_profile_compliance_score, c_acctbal AS elapsed_time_seconds
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
_AGG = f"""count(experiment_id) AS n_runs, {r("success_rate=avg(CAST(status IS NOT DISTINCT FROM 'success' AS INT))", "strict_llm_valid_rate=avg(CAST(strict_llm_valid AS INT))", "mean_llm_profile_compliance_score=avg(llm_profile_compliance_score)", "std_llm_profile_compliance_score=stddev_samp(llm_profile_compliance_score)", "mean_time_seconds=avg(elapsed_time_seconds)", "std_time_seconds=stddev_samp(elapsed_time_seconds)")}"""


def _rolled(spark, d, sets) -> DataFrame:
    return rollup.roll_up(_runs(spark, d).withColumn("strict_llm_valid", c.as_flag(F.col("strict_llm_valid"))), sets)


def _rollup(name: str, keys: tuple[str, ...]) -> None:
    QUERIES[name] = lambda spark, d: rounded(_rolled(spark, d, [keys]).drop("level"))
    ORACLE[name] = f"WITH {_RUNS} SELECT {', '.join(keys)}, {_AGG} FROM rn GROUP BY {', '.join(keys)}"


for _name, _keys in zip(("rollup_full", "rollup_model_method", "rollup_model", "rollup_profile_method"), rollup.ROLLUPS, strict=True):
    _rollup(_name, _keys)


@query(f"""WITH {_RUNS} SELECT batch_id, model, profile_id, method, grouping(batch_id, model, profile_id, method) AS level, {_AGG} FROM rn
GROUP BY GROUPING SETS ((batch_id, model, profile_id, method), (batch_id, model, method), (batch_id, model), (batch_id, profile_id, method))""")
def rollup_all(spark, d):
    return _rolled(spark, d, rollup.ROLLUPS)


@query(f"""WITH {_RUNS} SELECT model, {r("success_rate=avg(CAST(status IS NOT DISTINCT FROM 'success' AS INT))")} FROM rn WHERE profile_id IN ('BUILDING', 'MACHINERY') AND batch_id = 'b1' GROUP BY model""")
def filtered_runs(spark, d):
    return rollup.select_runs(_runs(spark, d), profile_ids=["BUILDING", "MACHINERY"], batch_id="b1").groupBy("model").agg(F.avg(F.col("status").eqNullSafe(F.lit("success")).cast("double")).alias("success_rate"))


def _flagged(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    text = lambda m: F.when(k % m == 0, "TRUE").when(k % m == 1, " y ").when(k % m == 2, "0")
    names = ["profile_parse_success", "raw_json_valid", "parse_repaired", "length_ok", "timestamps_not_null", "values_not_null", "daily_frequency_ok", "range_ok", "values_numeric", "increasing_trend_ok", "decreasing_trend_ok", "no_strong_trend_ok", "weekly_seasonality_ok"]
    pid = F.element_at(F.array(*[F.lit(p[0]) for p in model.PROFILES]), (k % 6 + 1).cast("int"))
    return table(spark, d, "orders").select(k.alias("id"), pid.alias("profile_id"), *[text(3 + i % 3).alias(n) for i, n in enumerate(names)], F.when(k % 4 == 0, k % 9).alias("completed_points"), F.when(k % 5 == 0, k % 7).alias("truncated_points"))


_F = lambda i: f"(o_orderkey % {3 + i % 3} < 2)"
_OLD = f"CASE o_orderkey % 6 WHEN 0 THEN {_F(11)} WHEN 1 THEN {_F(11)} AND {_F(12)} WHEN 2 THEN {_F(9)} AND {_F(12)} WHEN 3 THEN {_F(10)} WHEN 4 THEN {_F(11)} AND {_F(12)} ELSE {_F(9)} AND {_F(12)} END"
_PARSE, _STRUCT = f"({_F(0)} OR {_F(1)} OR {_F(2)})", " AND ".join(_F(i) for i in range(3, 9))


@query(f"""SELECT o_orderkey AS id, {_PARSE} AS parse_success, {_STRUCT} AND {_PARSE} AS legacy_structural_valid, {_OLD} AS legacy_temporal_valid, {_STRUCT} AND {_PARSE} AND ({_OLD}) AS legacy_final_recomputed,
  CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 9 ELSE 0 END + CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 7 ELSE 0 END AS curation_intensity FROM orders""")
def derived_flags(spark, d):
    return rollup.derived_flags(_flagged(spark, d)).select("id", "parse_success", "legacy_structural_valid", "legacy_temporal_valid", "legacy_final_recomputed", "curation_intensity")


@query(r"""SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(trim(p_name || ' / ' || p_type), '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g'), ''), 'unknown') AS slug,
  concat_ws('_', p_brand, 'prompt_only', CASE WHEN p_size % 2 = 0 THEN 'b' END, 'run' || p_size) AS experiment_id FROM part""")
def slug_ids(spark, d):
    name = c.slug(F.concat("p_name", F.lit(" / "), "p_type"))
    eid = F.concat_ws("_", "p_brand", F.lit("prompt_only"), F.when(F.col("p_size") % 2 == 0, "b"), F.concat(F.lit("run"), F.col("p_size").cast("string")))
    return table(spark, d, "part").select("p_partkey", name.alias("slug"), eid.alias("experiment_id"))


@query(r"""SELECT p_partkey, coalesce(TRY_CAST(nullif(regexp_extract(s, '_run(\d+)$', 1), '') AS INT), TRY_CAST(nullif(regexp_extract(s, 'run(\d+)', 1), '') AS INT)) AS run_id
FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'a_run' || p_size WHEN 1 THEN 'run' || p_size || '_x' ELSE 'none' END AS s FROM part)""")
def run_id_extract(spark, d):
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    s = F.when(k == 0, F.concat(F.lit("a_run"), size)).when(k == 1, F.concat(F.lit("run"), size, F.lit("_x"))).otherwise("none")
    return table(spark, d, "part").select("p_partkey", c.run_number(s).alias("run_id"))


@query(rf"SELECT doc_id, array_to_string(x, '|') AS numbers, CAST(len(x) AS INT) AS n, {r('total=list_sum(list_transform(x, lambda v: CAST(v AS DOUBLE)))')} FROM (SELECT doc_id, regexp_extract_all(text, '-?\d+(?:\.\d+)?') AS x FROM documents)")
def number_extract(spark, d):
    n = c.numbers(F.col("text"))
    total = F.when(F.size(n) > 0, F.aggregate(n, F.lit(0.0), lambda x, y: x + y))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.regexp_extract_all("text", F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), "|").alias("numbers"), F.when(F.col("text").isNotNull(), F.size(n)).alias("n"), total.alias("total"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("double").alias("k"))


# raw text; then as parsed: raw_json_valid, repair_type, shape, values, time stamps
PARSE_CASES = (
    ("[1, 2, 3]", True, None, "root:numeric_list", "1.0|2.0|3.0", None),
    ('[{"timestamp": "2024-01-01", "value": 1}]', True, None, "root:list_of_dicts", "1.0", "2024-01-01"),
    ("[1, 2", False, "added_closing_bracket", "root:numeric_list", "1.0|2.0", None),
    ("so: [4, 5] ok", False, "extracted_json_array_from_text", "root:numeric_list", "4.0|5.0", None),
    ("[1] and [2]", False, "extracted_numeric_values_from_text", "root:numeric_list", "1.0|2.0", None),
    ('{"output": {"values": [7, 8]}}', True, None, "root.output.values:numeric_list", "7.0|8.0", None),
    ('{"x": [2], "observations": [1, 3]}', True, None, "root.observations:numeric_list", "1.0|3.0", None),
    ('{"output": [7, 8], "time_series": [1, 2]}', True, None, "root.time_series:numeric_list", "1.0|2.0", None),
    ("[[1, 2]]", True, None, "root:single_nested_numeric_list", "1.0|2.0", None),
    ("[[1, 2], [3]]", True, None, "root[0]:numeric_list", "1.0|2.0", None),
    ('["1", "2"]', True, None, "root:numeric_list", "1.0|2.0", None),
    ('[{"v": 1}, {"v": "2"}]', True, None, "root:list_of_dicts|renamed_v_to_value|timestamps_constructed", "1.0|2.0", None),
    ('[{"value": 1, "info": {"a": [5]}}, {"value": null}]', True, None, "root:list_of_dicts|timestamps_constructed", "1.0|", None),
    ('[{"timestamp": "2024-01-02", "value": 3}, {"value": 4}]', True, None, "root:list_of_dicts", "3.0|4.0", "2024-01-02|"),
    ('[{"a": 1, "b": 2}]', True, None, None, None, None),
    ("[1, NaN]", True, None, None, None, None),
    ("5", True, None, None, None, None),
    ('{"a": {"b": "c"}}', True, None, None, None, None),
    ("", False, None, None, None, None),
    ("none here", False, None, None, None, None),
)


@query(f"SELECT CAST(p_partkey AS BIGINT) AS p_partkey, ok AS raw_json_valid, repair_type IS NOT NULL AS parse_repaired, repair_type, shape IS NULL AS failed, shape, vals, ts FROM part JOIN (VALUES {', '.join(f'({i}, ' + ', '.join('NULL' if v is None else str(v).lower() if isinstance(v, bool) else chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39) for v in x[1:]) + ')' for i, x in enumerate(PARSE_CASES))}) v(i, ok, repair_type, shape, vals, ts) ON p_partkey % {len(PARSE_CASES)} = i")
def parse_cascade(spark, d):
    """Every part carries one of the answers, so all rows of the table are parsed."""
    cases = spark.createDataFrame([(i, x[0]) for i, x in enumerate(PARSE_CASES)], "i int, raw string")
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), (F.col("p_partkey") % len(PARSE_CASES)).cast("int").alias("i")).join(F.broadcast(cases), "i")
    p = rows.withColumn("p", parse_series(F.col("raw")))
    joined = lambda x: F.array_join(F.transform(x, lambda v: F.coalesce(v.cast("string"), F.lit(""))), "|")
    return p.select("p_partkey", "p.raw_json_valid", "p.parse_repaired", "p.repair_type", F.col("p.error").isNotNull().alias("failed"), "p.shape", joined(F.col("p.vals")).alias("vals"), joined(F.col("p.ts")).alias("ts"))


@query(r"""SELECT doc_id, CAST(len(x) AS BIGINT) AS n_numbers, CASE WHEN len(x) > 0 THEN 'extracted_numeric_values_from_text' END AS repair_type FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '-?[0-9]+(?:\.[0-9]+)?') AS x FROM documents)""")
def parse_documents(spark, d):
    """All documents through the parser: prose holds no JSON, so numbers are taken where there are any."""
    p = table(spark, d, "documents").select("doc_id", parse_series(F.col("text")).alias("p"))
    return p.select("doc_id", F.coalesce(F.when(F.col("p.vals").isNotNull(), F.size("p.vals")), F.lit(0)).cast("long").alias("n_numbers"), "p.repair_type")


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS chosen FROM customer""")
def semi_anti_filters(spark, d):
    cust = table(spark, d, "customer").select("c_custkey")
    has = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return cust.join(has, "c_custkey", "left_semi").withColumn("chosen", F.lit(True)).unionByName(cust.join(has, "c_custkey", "left_anti").withColumn("chosen", F.lit(False)))


@query(f"WITH {S1} SELECT series_id, pos, {r('value')}, 'observed' AS origin FROM t1 WHERE pos < 20 UNION ALL SELECT series_id, pos, {r('value')}, 'rest' FROM t1 WHERE pos >= 20")
def union_points(spark, d):
    t = T1(spark, d).select("series_id", "pos", "value")
    return t.filter("pos < 20").withColumn("origin", F.lit("observed")).unionByName(t.filter("pos >= 20").withColumn("origin", F.lit("rest")), allowMissingColumns=True)


def _previous_sql(*keys: str) -> str:
    by = ", ".join(keys)
    return f"""WITH {_RUNS}, own AS (SELECT {by}, method, count(*) FILTER (status = 'success' AND experiment_id IS NOT NULL) AS c FROM rn GROUP BY ALL),
al AS (SELECT *, sum(c) OVER (PARTITION BY {by}) - c AS n FROM own)
SELECT experiment_id AS for_experiment_id, CAST(sum(n) AS BIGINT) AS n FROM rn JOIN al ON {' AND '.join(f'rn.{k} IS NOT DISTINCT FROM al.{k}' for k in (*keys, 'method'))} WHERE n > 0 GROUP BY 1"""


@query(_previous_sql("profile_id", "model", "batch_id"))
def previous_run_context(spark, d):
    """How many earlier runs each run's context has, for every run."""
    return rollup.previous_run_counts(_runs(spark, d))


@query(_previous_sql("profile_id"))
def previous_run_counts(spark, d):
    return rollup.previous_run_counts(_runs(spark, d), same_model=False, same_batch=False)


@query(f"""WITH {_RUNS}, x AS (SELECT profile_id, experiment_id, status = 'success' AS v, max(coalesce(status = 'success', false)) OVER (PARTITION BY profile_id, model, method) AS any_v FROM rn)
SELECT profile_id, count(*) AS n FROM x WHERE coalesce(v, false) = any_v GROUP BY 1""")
def prefer_valid(spark, d):
    rows = _runs(spark, d).withColumn("valid", F.col("status") == "success")
    return select.prefer_valid(rows, "profile_id", "model", "method").groupBy("profile_id").agg(F.count(F.lit(1)).alias("n"))


def _bank_sql(n: int = 30) -> str:
    def u(name: str, low: float, high: float, *more: str) -> str:
        return f"({low}::DOUBLE + ({high}::DOUBLE - {low}::DOUBLE) * {u_sql('reference_id', repr(name), *more)})"

    week = f"[{', '.join(f'{x}::DOUBLE' for x in bank.WEEK)}][pos % 7 + 1]"
    weekly = f"({u('shift', -8.0, 8.0)} + {u('amp', 0.85, 1.15)} * {week})"
    x = "(pos / (expected_length - 1)::DOUBLE)"
    return f"""{PROFILE_SQL},
b0 AS (SELECT *, profile_id || '_ref_' || lpad(CAST(k AS VARCHAR), 3, '0') AS reference_id FROM pr CROSS JOIN (SELECT unnest(generate_series(1, {n})) AS k)),
b1 AS (SELECT *, unnest(generate_series(0, expected_length - 1)) AS pos, CASE noise_expected WHEN 'low' THEN {u('s', 0.8, 2.0)} WHEN 'high' THEN {u('s', 5.0, 10.0)} ELSE {u('s', 2.0, 5.0)} END AS sigma FROM b0),
b2 AS (SELECT *, sigma * {normal_sql('reference_id', 'pos')} + CASE WHEN seasonality_expected = 'weekly' AND trend_expected = 'increasing' THEN {weekly} + {u('gain', 5.0, 12.0)} * (pos // 7)
    WHEN seasonality_expected = 'weekly' THEN {weekly} + 1.5::DOUBLE * {normal_sql('reference_id', 'pos', repr('w'))} WHEN trend_expected = 'increasing' THEN {u('start', 80.0, 120.0)} + {u('rise', 40.0, 110.0)} * {x}
    WHEN trend_expected = 'decreasing' THEN {u('start', 190.0, 240.0)} * (1 - {x}) + {u('end', 90.0, 130.0)} * {x} ELSE {u('level', 95.0, 110.0)} END AS value FROM b1),
b3 AS (SELECT *, regr_slope(value, pos) OVER w AS slope, max(value) OVER w - min(value) OVER w AS span FROM b2 WINDOW w AS (PARTITION BY reference_id)),
b4 AS (SELECT * EXCLUDE (value), CASE WHEN trend_expected = 'flat' AND abs(slope) * (expected_length - 1) / nullif(span, 0) > flat_trend_threshold THEN value - slope * (pos - (expected_length - 1) / 2.0::DOUBLE) ELSE value END AS value FROM b3),
b5 AS (SELECT *, row_number() OVER (PARTITION BY reference_id ORDER BY CASE WHEN expected_length <= 10 OR pos BETWEEN 3 AND expected_length - 4 THEN {u_sql('reference_id', 'pos', repr('place'))} END NULLS LAST, pos) <= expected_anomalies AS hit FROM b4),
b6 AS (SELECT reference_id, profile_id, pos, CAST(start_date AS DATE) + CAST(pos AS INT) AS ts, round_even(greatest(value_min, least(value_max, CASE WHEN NOT hit THEN value
    WHEN coalesce(anomaly_type = 'drops' OR (anomaly_type = 'mixed' AND {u_sql('reference_id', 'pos', repr('kind'))} < 0.35::DOUBLE), false) THEN value - {u('down', 50.0, 100.0, 'pos')}
    ELSE greatest(200 + {u('over', 30.0, 100.0, 'pos')}, value + {u('up', 80.0, 150.0, 'pos')}) END)), 2) AS value, seasonality_expected, expected_anomalies, trend_expected, noise_expected, description FROM b5)"""


@query(f"WITH {_bank_sql()} SELECT reference_id, profile_id, CAST(pos AS INT) AS pos, ts, {r('value')} FROM b6")
def bank_generate(spark, d):
    return bank.generate_bank(model.profiles(spark))


_FEATURE_SQL = """fe AS (SELECT reference_id, profile_id, count(*) AS length, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, regr_slope(value, pos) AS trend_slope, any_value(description) AS profile_description, any_value(noise_expected) AS noise,
  any_value(trend_expected) AS te, any_value(seasonality_expected) AS se, any_value(expected_anomalies) AS ea,
  CASE WHEN any_value(seasonality_expected) = 'weekly' AND count(*) >= 14 THEN coalesce(covar_pop(value, z) / nullif(stddev_pop(value) FILTER (z IS NOT NULL) * stddev_pop(z), 0), 0) END AS weekly_autocorrelation,
  CASE WHEN any_value(expected_anomalies) > 0 THEN CAST(count(*) FILTER (value >= 200) AS DOUBLE) END AS anomaly_count
  FROM (SELECT *, lag(value, 7) OVER (PARTITION BY reference_id ORDER BY pos) AS z FROM b6) GROUP BY 1, 2)"""


@query(f"""WITH {_bank_sql()}, {_FEATURE_SQL} SELECT reference_id, profile_id, profile_description, profile_id || '/' || reference_id AS path, length, {r('mean', 'std', 'min', 'max', 'trend_slope', 'weekly_autocorrelation', 'anomaly_count')},
  CASE te WHEN 'flat' THEN 'none' ELSE te END AS trend, se AS seasonality, CASE WHEN ea > 0 THEN 'point' ELSE 'none' END AS anomalies, noise, CASE te WHEN 'flat' THEN 'stable' ELSE te END AS trend_attribute,
  CASE se WHEN 'weekly' THEN 'weekly pattern' ELSE 'no periodicity' END AS periodicity_attribute, CASE WHEN ea > 0 THEN 'point anomalies' ELSE 'no local fluctuation' END AS local_fluctuation_attribute, noise || ' noise' AS noise_attribute FROM fe""")
def bank_features(spark, d):
    p = model.profiles(spark)
    return bank.bank_features(bank.generate_bank(p), p)


@query(f"WITH {_bank_sql()} SELECT profile_id, count(DISTINCT reference_id) AS n_references FROM b6 GROUP BY 1")
def bank_count_report(spark, d):
    p = model.profiles(spark)
    return rollup.count_report(bank.bank_features(bank.generate_bank(p), p))


_UNUSUAL = (("N1", "none"), ("N2", "no_strong_trend"), ("N3", "decreasing"), ("N4", "sideways"))


def _unusual_profiles(spark) -> DataFrame:
    """P4_30 with trends that no given profile has."""
    base = model.profiles(spark).filter("profile_id = 'P4_30'").drop("profile_id", "trend_expected")
    return base.crossJoin(F.broadcast(spark.createDataFrame(list(_UNUSUAL), "profile_id string, trend_expected string"))).select(*_names)


@query(f"""WITH {S2}, {stats_sql('t2').replace("pr AS (SELECT * FROM (VALUES", "pr AS (SELECT * EXCLUDE (nn, tt) REPLACE (nn AS profile_id, tt AS trend_expected) FROM (SELECT * FROM (VALUES", 1).replace("v(" + ", ".join(_names) + "))", "v(" + ", ".join(_names) + ") WHERE profile_id = 'P4_30') CROSS JOIN (VALUES " + _values(_UNUSUAL) + ") u(nn, tt))", 1).replace("WHEN trend_expected = 'increasing' THEN greatest(0, rho) ELSE greatest(0, -rho) END AS trend_score", "WHEN trend_expected = 'increasing' THEN greatest(0, rho) WHEN trend_expected = 'decreasing' THEN greatest(0, -rho) ELSE 0 END AS trend_score").replace("trend_expected = 'flat'", "trend_expected IN ('flat', 'none', 'no_strong_trend')")}
SELECT series_id, profile_id, {r('trend_observed', 'trend_score')} FROM sc""")
def trend_of_unusual_profiles(spark, d):
    return metrics.profile_metrics(T2(spark, d), _unusual_profiles(spark), model.noise_bands(spark)).select("series_id", "profile_id", "trend_observed", "trend_score")


def _gappy(spark, d) -> DataFrame:
    k = F.col("reference_id")
    return T6(spark, d).withColumn("mean", F.when(k % 5 != 0, F.col("mean"))).withColumn("std", F.when(k % 3 != 0, F.col("std"))).withColumn("none", F.lit(None).cast("double"))


@query(f"""WITH {S6}, gp AS (SELECT reference_id, n_orders, CASE WHEN reference_id % 5 <> 0 THEN mean END AS mean, CASE WHEN reference_id % 3 <> 0 THEN std END AS std FROM t6),
md AS (SELECT median(n_orders) AS a, median(mean) AS b, median(std) AS c FROM gp), fl AS (SELECT reference_id, n_orders, coalesce(mean, b) AS mean, coalesce(std, c) AS std, a, b, c FROM gp, md),
dv AS (SELECT coalesce(nullif(stddev_pop(n_orders), 0), 1) AS x, coalesce(nullif(stddev_pop(mean), 0), 1) AS y, coalesce(nullif(stddev_pop(std), 0), 1) AS z FROM fl),
q AS (SELECT reference_id, (n_orders - a) / x AS u, (mean - b) / y AS v, (std - c) / z AS w FROM fl, dv), o AS (SELECT * FROM q WHERE reference_id = 1)
SELECT q.reference_id, {r("distance=sqrt((q.u - o.u) ** 2 + (q.v - o.v) ** 2 + (q.w - o.w) ** 2)")} FROM q, o WHERE q.reference_id <> 1 ORDER BY sqrt((q.u - o.u) ** 2 + (q.v - o.v) ** 2 + (q.w - o.w) ** 2), q.reference_id LIMIT 10""")
def knn_with_nulls(spark, d):
    return select.nearest(_gappy(spark, d), ["n_orders", "mean", "std", "none"], 1, 10)


@query(f"WITH {S6} SELECT unnest([0.0, 0.1, 0.25, 0.5, 0.9, 1.0])::DOUBLE AS share, {r('value=unnest(quantile_cont(mean, [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]))')} FROM t6")
def exact_quantiles(spark, d):
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    found = select.exact_quantiles(T6(spark, d), "mean", shares)
    return spark.createDataFrame(list(zip(shares, found, strict=True)), "share double, value double")


# References, planned runs and earlier runs made from customers and their orders.
_CUSTOMERS = """cs AS (SELECT c_custkey AS k, c_mktsegment AS profile_id, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std, round(max(o_totalprice) - min(o_totalprice), 4) AS trend_slope,
  CASE WHEN c_custkey % 3 <> 0 AND c_mktsegment <> 'FURNITURE' THEN round(c_acctbal / 10000, 6) END AS weekly_autocorrelation, CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(count(*) AS DOUBLE) END AS anomaly_count
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment, c_acctbal),
rf AS (SELECT 'r' || k AS reference_id, * EXCLUDE (k) FROM cs WHERE k % 4 <> 0),
ge AS (SELECT 'g' || k AS experiment_id, 'm' || ((k // 4) % 3) AS model, 'b' AS batch_id, CASE WHEN k % 20 = 0 THEN 'tabgen_icl_residual' ELSE 'prompt_only' END AS method, CASE WHEN k % 28 = 0 THEN 'failed' ELSE 'success' END AS status, k % 8 = 0 AND k % 3 <> 0 AS valid_series, cs.* EXCLUDE (k) FROM cs WHERE k % 4 = 0),
rq AS (SELECT profile_id || '_' || m || '_' || n AS experiment_id, profile_id, m AS model, 'b' AS batch_id, n AS run_id, 4 AS n_examples, 42 AS selection_seed, 42 + n AS seed FROM (SELECT DISTINCT profile_id FROM cs) CROSS JOIN (VALUES ('m0'), ('m1'), ('m9')) a(m) CROSS JOIN (SELECT unnest([1, 2, 3]) AS n))"""


def _customers(spark, d) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("o_totalprice", F.col("o_totalprice").cast("double"))
    k, seg, price = F.col("k"), F.col("profile_id"), F.col("o_totalprice")
    per = o.groupBy(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("profile_id"), F.col("c_acctbal").cast("double").alias("bal")).agg(F.round(F.avg(price), 4).alias("mean"), F.round(F.stddev_pop(price), 4).alias("std"), F.round(F.max(price) - F.min(price), 4).alias("trend_slope"), F.count(F.lit(1)).cast("double").alias("n"))
    return per.select("k", "profile_id", "mean", "std", "trend_slope", F.when((k % 3 != 0) & (seg != "FURNITURE"), F.round(F.col("bal") / 10000, 6)).alias("weekly_autocorrelation"), F.when(seg != "BUILDING", F.col("n")).alias("anomaly_count"))


def _references(spark, d) -> DataFrame:
    return _customers(spark, d).filter("k % 4 <> 0").withColumn("reference_id", F.concat(F.lit("r"), F.col("k"))).drop("k").persist()


def _earlier(spark, d) -> tuple[DataFrame, DataFrame]:
    """Features of earlier series, and their runs."""
    k = F.col("k")
    rows = _customers(spark, d).filter("k % 4 = 0").withColumn("series_id", F.concat(F.lit("g"), k))
    runs = rows.select(F.col("series_id").alias("experiment_id"), "profile_id", F.concat(F.lit("m"), F.floor(k / 4) % 3).alias("model"), F.lit("b").alias("batch_id"), F.when(k % 20 == 0, "tabgen_icl_residual").otherwise("prompt_only").alias("method"), F.when(k % 28 == 0, "failed").otherwise("success").alias("status"), ((k % 8 == 0) & (k % 3 != 0)).alias("valid_series"))
    return rows.drop("k", "profile_id"), runs


def _requests(spark, d) -> DataFrame:
    seg = _customers(spark, d).select("profile_id").distinct()
    rows = seg.withColumn("model", F.explode(F.array(*map(F.lit, ("m0", "m1", "m9"))))).withColumn("run_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    return rows.withColumns({"batch_id": F.lit("b"), "n_examples": F.lit(4), "selection_seed": F.lit(42), "experiment_id": F.concat_ws("_", "profile_id", "model", F.col("run_id").cast("string"))})


@query(f"""WITH {_CUSTOMERS}, x AS (SELECT experiment_id, n_examples, reference_id, row_number() OVER (PARTITION BY experiment_id ORDER BY {u_sql('reference_id', seed='seed')}, reference_id) AS position FROM rq JOIN rf USING (profile_id))
SELECT experiment_id, CAST(position AS INT) AS position, reference_id FROM x WHERE position <= n_examples""")
def random_examples(spark, d):
    return examples.random_examples(_requests(spark, d), _references(spark, d))


_F5 = ("mean", "std", "trend_slope", "weekly_autocorrelation", "anomaly_count")


@query(f"""WITH {_CUSTOMERS}, m AS (SELECT profile_id, {', '.join(f'median({c}) AS m_{c}' for c in _F5)} FROM rf GROUP BY 1), f AS (SELECT rf.profile_id, reference_id, {', '.join(f'coalesce({c}, m_{c}) AS {c}, m_{c}' for c in _F5)} FROM rf JOIN m USING (profile_id)),
sd AS (SELECT profile_id, {', '.join(f'coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}' for c in _F5)} FROM f GROUP BY 1),
z AS (SELECT profile_id, reference_id, {', '.join(f'coalesce(({c} - m_{c}) / s_{c}, 0) AS {c}' for c in _F5)}, row_number() OVER (PARTITION BY profile_id ORDER BY reference_id) - 1 AS place, count(*) OVER (PARTITION BY profile_id) AS available FROM f JOIN sd USING (profile_id)),
an AS (SELECT rq.*, z.reference_id AS anchor_reference_id, z.place AS anchor_position, {', '.join(f'z.{c} AS a_{c}' for c in _F5)} FROM rq JOIN z USING (profile_id) WHERE z.place = CAST(floor({u_sql("'anchor'", seed='seed')} * available) AS INT)),
di AS (SELECT an.*, z.reference_id, sqrt({' + '.join(f'(z.{c} - a_{c}) ** 2' for c in _F5)}) AS distance FROM an JOIN z USING (profile_id) WHERE z.reference_id <> anchor_reference_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY distance, reference_id) AS position FROM di)
SELECT experiment_id, CAST(position AS INT) AS position, reference_id, {r('distance')}, anchor_reference_id, CAST(anchor_position AS INT) AS anchor_position FROM rk WHERE position <= n_examples""")
def anchor_neighbours(spark, d):
    return examples.anchor_neighbours(_requests(spark, d), _references(spark, d))


_GENERATED = """us AS (SELECT * FROM ge WHERE status = 'success' AND method <> 'tabgen_icl_residual'), gd AS (SELECT * FROM (SELECT *, max(valid_series) OVER (PARTITION BY profile_id, model, batch_id) AS any_valid FROM us) WHERE valid_series = any_valid)"""


def _known(spark, d) -> DataFrame:
    return examples.generated_features(*_earlier(spark, d)).persist()


@query(f"WITH {_CUSTOMERS}, {_GENERATED} SELECT experiment_id, profile_id, model, batch_id, {r(*_F5)} FROM gd")
def generated_features(spark, d):
    return _known(spark, d).select("experiment_id", "profile_id", "model", "batch_id", *_F5)


def _subset_sql() -> str:
    """CTEs up to ``ca`` (experiment_id, candidate_id, ids) and ``di`` (with their distance)."""
    long = lambda t, keep: " UNION ALL ".join(f"SELECT {keep}, {i} AS f, CAST({c} AS DOUBLE) AS x FROM {t} WHERE {c} IS NOT NULL" for i, c in enumerate(_F5))
    slot = "CASE WHEN x BETWEEN lo AND hi THEN least(k - 1, coalesce(CAST(floor((x - lo) / nullif(hi - lo, 0) * k) AS BIGINT), 0)) END"
    return f"""{_CUSTOMERS}, {_GENERATED}, lr AS ({long('rf', 'profile_id, reference_id')}), lg AS ({long('gd', 'profile_id, model, batch_id')}),
st AS (SELECT profile_id, f, min(x) AS lo, max(x) AS hi, count(DISTINCT x) AS u, count(*) AS m, least(10, greatest(2, count(DISTINCT x))) AS k, least(5, count(DISTINCT x)) AS q, list(x ORDER BY x) AS xs FROM lr GROUP BY 1, 2),
cu AS (SELECT profile_id, f, list_distinct(list_transform(generate_series(0, q), lambda i: xs[CAST(floor((m - 1) * i / q) AS INT) + 1] + (xs[CAST(ceil((m - 1) * i / q) AS INT) + 1] - xs[CAST(floor((m - 1) * i / q) AS INT) + 1]) * ((m - 1) * i / q - floor((m - 1) * i / q)))) AS cuts FROM st WHERE m >= 2 AND u >= 2),
bi AS (SELECT lr.profile_id, lr.f, reference_id, greatest(0, len(list_filter(cuts, lambda c: c < x)) - 1) AS bin FROM lr JOIN cu USING (profile_id, f)),
uf AS (SELECT DISTINCT experiment_id, rq.profile_id, rq.model, rq.batch_id, n_examples, seed, lr.f FROM rq JOIN lr USING (profile_id) JOIN lg ON lg.profile_id = rq.profile_id AND lg.model = rq.model AND lg.batch_id = rq.batch_id AND lg.f = lr.f),
ro AS (SELECT experiment_id, n_examples, seed, f * 100 + bin AS place, reference_id FROM uf JOIN bi USING (profile_id, f)
  UNION ALL SELECT experiment_id, n_examples, seed, place, reference_id FROM (SELECT DISTINCT experiment_id, profile_id, n_examples, seed FROM uf) JOIN rf USING (profile_id) CROSS JOIN (SELECT unnest(generate_series(10000, 10009)) AS place)),
tu AS (SELECT *, row_number() OVER (PARTITION BY experiment_id, place ORDER BY {u_sql('reference_id', 'place', seed='seed')}, reference_id) AS turn FROM ro),
se AS (SELECT experiment_id, place, list(reference_id ORDER BY reference_id) AS ids FROM tu WHERE turn <= n_examples GROUP BY 1, 2),
ca AS (SELECT * FROM (SELECT experiment_id, ids, row_number() OVER (PARTITION BY experiment_id ORDER BY min(place)) - 1 AS candidate_id FROM se GROUP BY experiment_id, ids) WHERE candidate_id < 30),
va AS (SELECT uf.experiment_id, candidate_id, uf.profile_id, uf.f, lg.x FROM uf JOIN ca USING (experiment_id) JOIN lg ON lg.profile_id = uf.profile_id AND lg.model = uf.model AND lg.batch_id = uf.batch_id AND lg.f = uf.f
  UNION ALL SELECT c.experiment_id, candidate_id, uf.profile_id, uf.f, lr.x FROM (SELECT experiment_id, candidate_id, unnest(ids) AS reference_id FROM ca) c JOIN uf ON uf.experiment_id = c.experiment_id JOIN lr ON lr.profile_id = uf.profile_id AND lr.f = uf.f AND lr.reference_id = c.reference_id),
ch AS (SELECT experiment_id, candidate_id, profile_id, f, {slot} AS bin, count(*) AS c FROM va JOIN st USING (profile_id, f) GROUP BY ALL),
rh AS (SELECT profile_id, f, {slot} AS bin, count(*) AS c FROM lr JOIN st USING (profile_id, f) GROUP BY ALL),
gr AS (SELECT a.*, lo = hi AS constant, b.bin, coalesce(rh.c, 0) + 1.0::DOUBLE AS p, coalesce(ch.c, 0) + 1.0::DOUBLE AS w FROM (SELECT DISTINCT experiment_id, candidate_id, profile_id, f FROM va) a JOIN st USING (profile_id, f) CROSS JOIN (SELECT unnest(generate_series(0, 9)) AS bin) b
  LEFT JOIN rh ON rh.profile_id = a.profile_id AND rh.f = a.f AND rh.bin = b.bin LEFT JOIN ch ON ch.experiment_id = a.experiment_id AND ch.candidate_id = a.candidate_id AND ch.f = a.f AND ch.bin = b.bin WHERE b.bin < k),
sh AS (SELECT *, p / sum(p) OVER g AS pp, w / sum(w) OVER g AS ww FROM gr WINDOW g AS (PARTITION BY experiment_id, candidate_id, f)),
fd AS (SELECT experiment_id, candidate_id, f, sqrt(greatest(0, sum((pp * ln(pp / ((pp + ww) / 2)) + ww * ln(ww / ((pp + ww) / 2))) / 2))) AS d FROM sh GROUP BY 1, 2, 3),
di AS (SELECT experiment_id, candidate_id, any_value(ids) AS ids, avg(d) AS distance FROM fd JOIN ca USING (experiment_id, candidate_id) GROUP BY 1, 2)"""


def _usable_requests(spark, d) -> DataFrame:
    known = examples.usable_features(_references(spark, d), "profile_id").withColumnRenamed("names", "bank")
    made = examples.usable_features(_known(spark, d), "profile_id", "model", "batch_id").withColumnRenamed("names", "made")
    rows = _requests(spark, d).join(known, "profile_id").join(made, ["profile_id", "model", "batch_id"])
    return rows.withColumn("names", F.filter("bank", lambda x: F.array_contains("made", x)))


@query(f"WITH {_subset_sql()} SELECT experiment_id, CAST(candidate_id AS INT) AS candidate_id, array_to_string(ids, '|') AS reference_ids FROM ca")
def candidate_subsets(spark, d):
    return examples.candidate_subsets(_usable_requests(spark, d), _references(spark, d)).withColumn("reference_ids", F.array_join("reference_ids", "|"))


@query(f"WITH {_subset_sql()} SELECT experiment_id, CAST(candidate_id AS INT) AS candidate_id, {r('distance')} FROM di")
def subset_distances(spark, d):
    rows, refs = _usable_requests(spark, d), _references(spark, d)
    return examples.subset_distances(rows, refs, _known(spark, d), examples.candidate_subsets(rows, refs)).select("experiment_id", "candidate_id", "distance")


@query(f"""WITH {_subset_sql()}, be AS (SELECT experiment_id, count(*) AS n_candidate_subsets, min(distance) AS distance, list(ids ORDER BY round(distance, 12), candidate_id)[1] AS ids FROM di GROUP BY 1),
cn AS (SELECT profile_id, model, batch_id, count(*) AS n FROM gd GROUP BY ALL),
al AS (SELECT rq.*, rf.reference_id, be.ids, be.distance, be.n_candidate_subsets, cn.n FROM rq JOIN rf USING (profile_id) LEFT JOIN be USING (experiment_id) LEFT JOIN cn ON cn.profile_id = rq.profile_id AND cn.model = rq.model AND cn.batch_id = rq.batch_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY CASE WHEN list_contains(ids, reference_id) THEN list_position(ids, reference_id) ELSE 1000000 END, {u_sql('reference_id', seed='seed')}, reference_id) AS position FROM al)
SELECT experiment_id, CAST(position AS INT) AS position, reference_id, {r('distance')}, n_candidate_subsets, CASE WHEN n IS NULL THEN 'no_previous_generated_series' END AS fallback_reason, coalesce(n, 0) AS generated_context_count FROM rk WHERE position <= n_examples""")
def residual_examples(spark, d):
    found = examples.residual_examples(_requests(spark, d), _references(spark, d), _known(spark, d))
    return found.select("experiment_id", "position", "reference_id", "distance", "n_candidate_subsets", "fallback_reason", "generated_context_count")


def _role_sql() -> str:
    steps = [
        ("CASE WHEN trend = 'increasing' THEN 'trend_attribute' ELSE 'stable_trend_attribute' END", "CASE WHEN trend = 'increasing' THEN -trend_slope ELSE abs(trend_slope) END", "trend = 'increasing'", "true"),
        ("'periodicity_attribute'", "-weekly_autocorrelation", "true", "seasonality = 'weekly'"),
        ("'local_fluctuation_attribute'", "abs(anomaly_count - expected_anomalies) + abs(trend_slope)", "false", "anomalies = 'point'"),
        ("'noise_attribute'", "std", "false", "true"),
    ]
    out = [f"""{_CUSTOMERS}, q0 AS (SELECT rq.*, CASE profile_id WHEN 'BUILDING' THEN 'increasing' WHEN 'HOUSEHOLD' THEN 'decreasing' ELSE 'none' END AS trend, CASE WHEN profile_id IN ('BUILDING', 'MACHINERY', 'FURNITURE') THEN 'weekly' ELSE 'none' END AS seasonality,
  CASE WHEN profile_id IN ('BUILDING', 'MACHINERY') THEN 'point' ELSE 'none' END AS anomalies, 3 AS expected_anomalies, rf.* EXCLUDE (profile_id), CAST(NULL AS VARCHAR) AS role, CAST(NULL AS INT) AS step, CAST(NULL AS DOUBLE) AS score FROM rq JOIN rf USING (profile_id))"""]
    for i, (role, value, largest, asked) in enumerate(steps):
        hit = f"(v IS NOT NULL AND rnk = floor({u_sql(repr(f'role{i}'), seed='seed')} * cnt) + 1)"
        out.append(f"""a{i} AS (SELECT *, CASE WHEN role IS NULL AND {asked} THEN CAST({value} AS DOUBLE) END AS v0 FROM q{i}), b{i} AS (SELECT *, max(v0 IS NOT NULL) OVER (PARTITION BY experiment_id) AS anyv FROM a{i}),
c{i} AS (SELECT *, CASE WHEN role IS NULL AND {asked} THEN CASE WHEN anyv THEN v0 ELSE 0 END END AS v FROM b{i}), d{i} AS (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY v NULLS LAST, reference_id) AS rnk, least(5, count(v) OVER (PARTITION BY experiment_id)) AS cnt FROM c{i}),
q{i + 1} AS (SELECT * EXCLUDE (v0, anyv, v, rnk, cnt) REPLACE (CASE WHEN {hit} THEN CASE WHEN anyv THEN CASE WHEN {largest} THEN -v ELSE v END ELSE 0 END ELSE score END AS score, CASE WHEN {hit} THEN {i} ELSE step END AS step, CASE WHEN {hit} THEN {role} ELSE role END AS role) FROM d{i})""")
    return ", ".join(out)


@query(f"""WITH {_role_sql()}, rk AS (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY step NULLS LAST, {u_sql('reference_id', repr('filler'), seed='seed')}, reference_id) AS position FROM q4)
SELECT experiment_id, CAST(position AS INT) AS position, reference_id, coalesce(role, 'filler_reference') AS role, {r('score')} FROM rk WHERE position <= n_examples""")
def role_examples(spark, d):
    seg = F.col("profile_id")
    rows = _requests(spark, d).withColumns({
        "trend": F.when(seg == "BUILDING", "increasing").when(seg == "HOUSEHOLD", "decreasing").otherwise("none"), "seasonality": F.when(seg.isin("BUILDING", "MACHINERY", "FURNITURE"), "weekly").otherwise("none"),
        "anomalies": F.when(seg.isin("BUILDING", "MACHINERY"), "point").otherwise("none"), "expected_anomalies": F.lit(3),
    })
    return examples.role_examples(rows, _references(spark, d)).select("experiment_id", "position", "reference_id", "role", "score")


@query(f"""WITH {PROFILE_SQL} SELECT profile_id, expected_length AS length, 'daily' AS frequency, CASE trend_expected WHEN 'flat' THEN 'none' ELSE trend_expected END AS trend, seasonality_expected AS seasonality, CASE WHEN expected_anomalies > 0 THEN 'point' ELSE 'none' END AS anomalies, noise_expected AS noise,
  {r("anomaly_threshold=200", "normal_min=80", "normal_max=CASE profile_id WHEN 'P3_28' THEN 180 WHEN 'P6_60' THEN 190 ELSE 130 END", "bank_normal_max=130", "no_strong_trend_threshold=flat_trend_threshold")}, true AS agrees FROM pr""")
def older_profiles(spark, d):
    dim = model.profiles(spark)
    old, made = model.legacy_profile(dim), model.bank_profile(dim).select("profile_id", F.col("normal_max").alias("bank_normal_max"))
    return old.join(made, "profile_id").join(model.profile_agreement(dim, old), "profile_id").select("profile_id", "length", "frequency", "trend", "seasonality", "anomalies", "noise", "anomaly_threshold", "normal_min", "normal_max", "bank_normal_max", "no_strong_trend_threshold", "agrees")


@query(f"""WITH me AS (SELECT * FROM (VALUES {_values([(i, *m[:2], str(m[2]).lower()) for i, m in enumerate(model.METHODS)])}) v(i, method, method_family, vo)), ru AS (SELECT o_orderkey, method, method_family, vo = 'true' AS value_only, o_orderkey % 6 AS p FROM orders JOIN me ON o_orderkey % 11 = i)
SELECT o_orderkey AS run_id, method, method_family, value_only, ['P1_20', 'P2_28', 'P3_28', 'P4_30', 'P5_60', 'P6_60'][p + 1] AS profile_id, ['P1_20', 'P2_28', 'P3_28', 'P4_30', 'P5_60', 'P6_60'][p + 1] || '_' || method || '_a_model_b' || (o_orderkey % 2) || '_run' || o_orderkey AS experiment_id FROM ru""")
def planned_runs(spark, d):
    k = F.col("o_orderkey")
    name = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    plan = table(spark, d, "orders").select(k.alias("run_id"), name([m[0] for m in model.METHODS], k % 11).alias("method"), name([p[0] for p in model.PROFILES], k % 6).alias("profile_id"), F.lit("a model").alias("model"), F.concat(F.lit("b"), (k % 2).cast("string")).alias("batch_id"))
    return workflow.planned(plan, model.profiles(spark), model.methods(spark)).select("run_id", "method", "method_family", "value_only", "profile_id", "experiment_id")


def _attempts(spark, d) -> DataFrame:
    """Daily sums of each user as answers: lists, lists without their end, and prose; profiles P1_20 and P4_30."""
    k = F.col("series_id").cast("long")
    listed = T2(spark, d).groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("p")).select("series_id", F.array_join(F.transform("p", lambda x: x["value"].cast("string")), ", ").alias("x"))
    raw = F.when(k % 7 == 0, "nothing to say").when(k % 5 == 0, F.concat(F.lit("["), "x")).otherwise(F.concat(F.lit("["), "x", F.lit("]")))
    plan = listed.select(F.col("series_id").alias("attempt_id"), raw.alias("raw"), k.alias("run_id"), F.when(k % 2 == 0, "P1_20").otherwise("P4_30").alias("profile_id"), F.lit("prompt_only").alias("method"), F.lit("m").alias("model"), F.lit("b").alias("batch_id"))
    return workflow.planned(plan, model.profiles(spark), model.methods(spark)).withColumn("status", F.lit("success")).withColumn("error_message", F.lit(None).cast("string"))


@query(f"""WITH {S2}, g0 AS (SELECT series_id, CAST(series_id AS BIGINT) AS k, CASE WHEN CAST(series_id AS BIGINT) % 2 = 0 THEN 20 ELSE 30 END AS goal, CAST(series_id AS BIGINT) % 2 = 1 AS falling, pos, greatest(0, least(1000, value)) AS value FROM t2),
g1 AS (SELECT * FROM g0 WHERE pos < goal AND k % 7 <> 0), g2 AS (SELECT series_id, any_value(goal) AS goal, any_value(falling) AS falling, count(*) AS n, arg_max(value, pos) AS la FROM g1 GROUP BY 1),
g3 AS (SELECT series_id, coalesce((arg_max(value, pos) - arg_min(value, pos)) / nullif(count(*) - 1, 0), 0) AS x FROM g1 JOIN g2 USING (series_id) WHERE pos >= n - 5 GROUP BY 1),
g4 AS (SELECT series_id, pos, value FROM g1 UNION ALL SELECT series_id, p.pos, greatest(0, least(1000, la + (CASE WHEN n < 2 THEN CASE WHEN falling THEN -1 ELSE 1 END WHEN NOT falling THEN 0 WHEN x < 0 THEN x WHEN x > 0 THEN -x ELSE -1 END) * (p.pos - n + 1))) FROM g2 JOIN g3 USING (series_id) CROSS JOIN (SELECT unnest(generate_series(0, 29)) AS pos) p WHERE p.pos >= n AND p.pos < goal),
g5 AS (SELECT series_id, any_value(goal) AS goal, any_value(falling) AS falling, any_value(n) AS n, count(*) AS m, coalesce(regr_slope(value, CAST(pos AS DOUBLE)), 0) AS slope FROM g4 JOIN g2 USING (series_id) GROUP BY 1),
g6 AS (SELECT *, CASE WHEN falling THEN NOT slope < 0 ELSE abs(slope) > 0.3::DOUBLE END AS bad FROM g5)
SELECT i.series_id AS attempt_id, CASE WHEN g6.n IS NULL THEN 'failed' ELSE 'success' END AS status, CASE WHEN g6.n IS NULL THEN 'no JSON and no numbers in the text' WHEN i.k % 5 = 0 THEN 'added_closing_bracket' ELSE 'none' END AS parse_error_type,
  coalesce(n, 0) AS n_before, coalesce(m, 0) AS n_after, coalesce(goal - n, 0) AS completed_points, CASE WHEN g6.n IS NULL THEN 999 ELSE CAST(bad AS INT) END AS n_failed_checks, coalesce(NOT bad, false) AS valid_series, CASE WHEN g6.n IS NULL THEN 0 ELSE 1 END AS timestamps, {r('slope')},
  {r('quality_score=CASE WHEN g6.n IS NULL THEN -9999 ELSE 15 + CASE WHEN bad THEN -10 ELSE 100 END + CASE WHEN falling THEN 0 ELSE CASE WHEN bad THEN -15 ELSE 25 END - least(abs(slope), 20) END END')}
FROM (SELECT DISTINCT series_id, k FROM g0) i LEFT JOIN g6 ON g6.series_id = i.series_id""")
def judged_attempts(spark, d):
    c = F.col
    j = workflow.judge(_attempts(spark, d), lambda df, name: df.persist())
    return j.select(
        "attempt_id", "status", "parse_error_type", F.size("values_before_curation").cast("long").alias("n_before"), F.size("values_after_curation").cast("long").alias("n_after"), c("structural_curation_info.completed_points").cast("long").alias("completed_points"),
        "n_failed_checks", "valid_series", c("timestamp_score").cast("int").alias("timestamps"), c("validation.trend_slope").alias("slope"), "quality_score",
    )


@query(f"""WITH {_CHECK_SQL} SELECT CAST(series_id AS BIGINT) % 10 AS grp, count(*) AS n_candidates, count(*) FILTER (CAST(series_id AS BIGINT) % 3 <> 0) AS n_successful_candidates, count(*) FILTER (CAST(series_id AS BIGINT) % 3 <> 0 AND len(failed) = 0) AS n_valid_candidates,
  {r("valid_candidates_rate=count(*) FILTER (CAST(series_id AS BIGINT) % 3 <> 0 AND len(failed) = 0) / count(*)")}, count(*) FILTER (CAST(series_id AS BIGINT) % 3 <> 0) = 0 AS all_failed FROM fl GROUP BY 1""")
def candidate_summary(spark, d):
    k = F.col("series_id").cast("long")
    rows = _checked(spark, d).withColumn("status", F.when(k % 3 != 0, "success").otherwise("failed"))
    return validate.candidate_summary(validate.quality_score(rows, "none", True, None, status=F.col("status")).withColumn("grp", k % 10), "grp")


@query(f"""WITH {_RUNS} SELECT model, method, {r("success_rate=avg(CAST(status IS NOT DISTINCT FROM 'success' AS INT))", "mean_llm_profile_compliance_score=avg(llm_profile_compliance_score)")}, CAST(row_number() OVER (ORDER BY avg(llm_profile_compliance_score) DESC NULLS LAST, avg(CAST(strict_llm_valid AS INT)) DESC NULLS LAST) AS INT) AS place FROM rn GROUP BY 1, 2""")
def rollup_report(spark, d):
    rolled = _rolled(spark, d, [("model", "method")]).withColumn("length_curation_rate", F.lit(None).cast("double"))
    order = Window.orderBy(F.desc_nulls_last("mean_llm_profile_compliance_score"), F.desc_nulls_last("strict_llm_valid_rate"), F.asc_nulls_last("length_curation_rate"))
    return rolled.select("model", "method", "success_rate", "mean_llm_profile_compliance_score", F.row_number().over(order).alias("place"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '- it has the wrong number of values' || chr(10) || '- no rhythm of seven days can be seen' WHEN 1 THEN '- some values lie outside the allowed range' ELSE 'All checks passed.' END
  || CASE WHEN p_size % 3 < 2 THEN chr(10) || '- slope of the answer: ' || printf('%.4f', CAST(p_size AS DOUBLE)) ELSE '' END AS feedback, ['Put the spikes far apart.', 'Put the spikes at other places than the first answer does.', 'Make the spikes clearly higher than all other values.', 'Keep trend and rhythm between the spikes.', 'Let each spike be a single day.', 'Differ from the other answers.'][least(6, p_size % 8 + 1)] AS variation FROM part""")
def feedback_and_variation(spark, d):
    k = F.col("p_size") % 3
    failed = F.when(k == 0, F.array(F.lit("length_ok"), F.lit("weekly_seasonality_ok"))).when(k == 1, F.array(F.lit("range_ok"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, d, "part").withColumns({"trend": F.lit("increasing"), "seasonality": F.lit("weekly"), "anomalies": F.lit("point")})
    return rows.select("p_partkey", prompts.feedback_text(failed, F.col("p_size").cast("double")).alias("feedback"), prompts.variation_text(F.col("p_size") % 8 + 1).alias("variation"))


@query(f"WITH {_subset_sql()} SELECT * FROM (SELECT experiment_id, CAST(row_number() OVER (PARTITION BY experiment_id ORDER BY round(distance, 12), candidate_id) AS INT) AS rank, CAST(candidate_id AS INT) AS candidate_id, array_to_string(ids, '|') AS reference_ids, {r('distance')} FROM di) WHERE rank <= 5")
def best_subsets(spark, d):
    """The five best subsets of each run, as its record tells them."""
    found = examples.residual_examples(_requests(spark, d), _references(spark, d), _known(spark, d)).filter("position = 1 and fallback_reason is null")
    rows = found.select("experiment_id", F.explode("candidate_scores_summary").alias("s"))
    return rows.select("experiment_id", "s.rank", "s.candidate_id", F.array_join("s.reference_ids", "|").alias("reference_ids"), "s.distance")


@query(f"WITH {_CUSTOMERS} SELECT profile_id, array_to_string(list_filter([{', '.join(f'CASE WHEN count({x}) > 0 THEN {chr(39)}{x}{chr(39)} END' for x in _F5)}], lambda x: x IS NOT NULL), '|') AS names FROM rf GROUP BY 1")
def usable_features(spark, d):
    return examples.usable_features(_references(spark, d), "profile_id").withColumn("names", F.array_join("names", "|"))


@query(f"""WITH {S1} SELECT series_id, 'P3_28' AS profile_id, count(*) AS length, {r('mean=avg(value)', 'std=stddev_pop(value)', 'min=min(value)', 'max=max(value)', 'trend_slope=regr_slope(value, CAST(pos AS DOUBLE))')},
  CASE WHEN count(*) >= 14 THEN {r('a=coalesce(covar_pop(value, z) / nullif(stddev_pop(value) FILTER (z IS NOT NULL) * stddev_pop(z), 0), 0)').removesuffix(' AS a')} END AS weekly_autocorrelation, CAST(count(*) FILTER (value >= 200) AS DOUBLE) AS anomaly_count
FROM (SELECT *, lag(value, 7) OVER (PARTITION BY series_id ORDER BY pos) AS z FROM t1) GROUP BY 1""")
def generated_series_features(spark, d):
    return bank.series_features(T1(spark, d).withColumn("profile_id", F.lit("P3_28")), model.profiles(spark))


@query(f"""WITH {S1}, q AS (SELECT series_id, pos, floor(value * 4) / 4 AS v FROM t1) SELECT series_id, 'Example 2 (' || series_id || ')' || chr(10) || 'noise_attribute' || chr(10) || 'mean 1.50, deviation 0.25, slope -0.125' || chr(10) || '[' || string_agg(printf('%.2f', v), ', ' ORDER BY pos) || ']' AS example FROM q GROUP BY 1""")
def example_texts(spark, d):
    values = F.transform(F.sort_array(F.collect_list(F.struct("pos", (F.floor(F.col("value") * 4) / 4).alias("v")))), lambda x: x["v"])
    rows = T1(spark, d).groupBy("series_id").agg(values.alias("v"))
    return rows.select("series_id", prompts.example_text(F.lit(2), F.col("series_id"), F.col("v"), F.lit(1.5), F.lit(0.25), F.lit(-0.125), F.lit("noise_attribute")).alias("example"))


@query(f"""WITH {PROFILE_SQL} SELECT profile_id, CASE trend_expected WHEN 'flat' THEN 'stable' ELSE trend_expected END AS trend_type, CASE seasonality_expected WHEN 'weekly' THEN 'weekly' ELSE 'none' END AS periodicity_type, seasonality_period AS period,
  CASE WHEN expected_anomalies > 0 THEN 'point_spikes' ELSE 'none' END AS fluctuation_type, expected_anomalies AS expected_count, noise_expected AS noise_type,
  '- Trend: ' || trend_expected || chr(10) || '- Seasonality: ' || seasonality_expected || chr(10) || '- Anomalies: ' || expected_anomalies || chr(10) || '- Noise: ' || noise_expected AS pattern_text,
  CASE WHEN expected_anomalies > 0 THEN 'rising_weekly_spikes' WHEN seasonality_expected = 'weekly' THEN 'weekly' WHEN trend_expected = 'decreasing' THEN 'falling' ELSE 'level' END AS kind FROM pr""")
def profile_attributes(spark, d):
    dim = model.profiles(spark)
    rows = dim.join(model.legacy_profile(dim).select("profile_id", "trend", "seasonality", "anomalies", "noise"), "profile_id")
    a = prompts.attributes()
    return rows.select(
        "profile_id", a["trend_attribute"]["type"].alias("trend_type"), a["periodicity_attribute"]["type"].alias("periodicity_type"), a["periodicity_attribute"]["period"].alias("period"), a["local_fluctuation_attribute"]["type"].alias("fluctuation_type"),
        a["local_fluctuation_attribute"]["expected_count"].alias("expected_count"), a["noise_attribute"]["type"].alias("noise_type"), prompts.pattern_text().alias("pattern_text"), prompts.pattern().alias("kind"),
    )


@query()
def prompts_of_methods(spark, d):
    """The prompts of all methods for all profiles, with the daily series of events as examples."""
    values = F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"])
    shown = T1(spark, d).groupBy("series_id").agg(values.alias("v")).agg(F.sort_array(F.collect_list(prompts.values_text(F.col("v")))).alias("examples"))
    plan = model.profiles(spark).select("profile_id").crossJoin(F.broadcast(model.methods(spark).select("method"))).withColumns({"model": F.lit("m"), "batch_id": F.lit("b"), "run_id": F.lit(1)})
    runs = workflow.planned(plan, model.profiles(spark), model.methods(spark)).crossJoin(F.broadcast(shown)).withColumn("examples", F.when(F.col("uses_references"), F.col("examples")))
    return prompts.build_prompts(runs).select("experiment_id", "prompt")


_INPUTS = sorted({x for _, x, _ in AGGREGATES})


@query(f"""WITH rn AS (SELECT o_orderpriority AS model, CASE WHEN o_orderkey % 3 <> 0 THEN 'success' END AS status, {', '.join(f'CASE WHEN (o_orderkey + {j}) % 4 <> 0 THEN CAST((o_orderkey * 7 + {j * 3}) % 11 AS DOUBLE) END AS "{x}"' for j, x in enumerate(_INPUTS))} FROM orders)
SELECT model, count(*) AS n_runs, {r("success_rate=avg(CAST(status IS NOT DISTINCT FROM 'success' AS INT))")}, {', '.join(r(f'{n}={"stddev_samp" if k == "std" else "avg"}("{x}")') for n, x, k in AGGREGATES)} FROM rn GROUP BY 1""")
def rollup_all_aggregates(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.cast("string").alias("experiment_id"), F.col("o_orderpriority").alias("model"), F.when(k % 3 != 0, "success").alias("status"), *[F.when((k + j) % 4 != 0, ((k * 7 + j * 3) % 11).cast("double")).alias(x) for j, x in enumerate(_INPUTS)])
    return rollup.roll_up(rows, [("model",)]).drop("level")


_PATHS = list(dict.fromkeys(path for _, path, _ in COLUMNS))


def _field_sql(path: str, kind: str) -> str:
    k = _PATHS.index(path)
    if path == "experiment_id":
        return "'e' || o_orderkey || '_run' || (o_orderkey % 5)"
    flag = "CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END"
    return {"text": f"'t{k}_' || (o_orderkey % 7)", "number": f"CAST(o_orderkey % 13 + {k} AS DOUBLE) + 0.5::DOUBLE", "flag": f"coalesce({flag}, false)", "check": flag, "list": f"CASE WHEN o_orderkey % 2 = 0 THEN 'a{k}|b' END"}[kind]


@query(f"SELECT CAST(NULL AS VARCHAR) AS source_file, CAST(NULL AS VARCHAR) AS batch_id, CAST(NULL AS VARCHAR) AS profile_id, CAST(NULL AS VARCHAR) AS profile_description, CAST(o_orderkey % 5 AS INT) AS run_id, {', '.join(f'{_field_sql(path, kind)} AS {chr(34)}{name}{chr(34)}' for name, path, kind in COLUMNS)} FROM orders")
def flattened_records(spark, d):
    """Nested records as JSON texts, one for each order, read back and flattened to all their columns."""
    k, kinds = F.col("o_orderkey"), {path: kind for _, path, kind in reversed(COLUMNS)}

    def field(path: str) -> Column:
        i, kind = _PATHS.index(path), kinds[path]
        if path == "experiment_id":
            return F.concat(F.lit("e"), k, F.lit("_run"), k % 5)
        if kind == "text":
            return F.concat(F.lit(f"t{i}_"), k % 7)
        if kind == "number":
            return (k % 13 + i).cast("double") + 0.5
        return F.when(k % 2 == 0, F.array(F.lit(f"a{i}"), F.lit("b"))).otherwise(F.array().cast("array<string>")) if kind == "list" else F.when(k % 3 == 0, True).when(k % 3 == 1, False)

    def block(prefix: str) -> list[Column]:
        inner = list(dict.fromkeys(p[len(prefix) :].split(".")[0] for p in _PATHS if p.startswith(prefix)))
        return [(field(prefix + x) if prefix + x in kinds else F.struct(*block(f"{prefix}{x}."))).alias(x) for x in inner]

    texts = table(spark, d, "orders").select(F.to_json(F.struct(*block(""))).alias("record"))
    return rollup.flatten_runs(texts.select(F.from_json("record", rollup.run_schema()).alias("r")).select("r.*"))


@query(f"""WITH {_RUNS}, x AS (SELECT CASE WHEN method = 'F' THEN 'prompt_only' WHEN method = 'O' THEN 'harmonic_knn' ELSE 'unofficial' END AS method, CASE profile_id WHEN 'BUILDING' THEN 'P1_20' WHEN 'MACHINERY' THEN 'P6_60' ELSE 'P0' END AS profile_id, model FROM rn)
SELECT model, count(*) FILTER (profile_id <> 'P0' AND method <> 'unofficial') AS official, count(*) FILTER (profile_id <> 'P0') AS every_method FROM x GROUP BY 1""")
def report_defaults(spark, d):
    rows = _runs(spark, d).withColumns({"method": F.when(F.col("method") == "F", "prompt_only").when(F.col("method") == "O", "harmonic_knn").otherwise("unofficial"), "profile_id": F.when(F.col("profile_id") == "BUILDING", "P1_20").when(F.col("profile_id") == "MACHINERY", "P6_60").otherwise("P0")})
    one = rollup.report_runs(rows).groupBy("model").agg(F.count(F.lit(1)).alias("official"))
    return one.join(rollup.report_runs(rows, all_methods=True).groupBy("model").agg(F.count(F.lit(1)).alias("every_method")), "model", "full")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
