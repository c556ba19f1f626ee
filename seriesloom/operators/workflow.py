"""Runs from plan to record, all at once.

A plan has a row for each run (profile_id, method, model, batch_id, run_id,
n_examples, selection_seed and generation settings). Runs are joined with their
profile and method, examples are chosen, prompts made and sent, and answers
parsed, curated, completed, checked and scored as one table of points. A failed
run is a row like any other. Answers are written before they are used, so no
prompt is sent twice when a task is repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom import model
from seriesloom.functions.columns import experiment_id
from seriesloom.functions.parsing import parse_series, parse_status, parsed_points
from seriesloom.operators import bank, curate, examples, metrics, prompts, validate
from seriesloom.sources.generator import Generator, generate

PLAN = {"n_examples": 3, "selection_seed": 42, "temperature": 0.7, "num_predict": 2048, "timeout": 300}
REFINE, CANDIDATES = "validator_feedback_refinement", "cllm_generate_curate"
_SCORES = ("profile_compliance_score", "formal_validity_score", "temporal_profile_score")


def planned(plan: DataFrame, profiles: DataFrame, methods: DataFrame) -> DataFrame:
    """The plan with ids, profile columns in both vocabularies and method columns; unknown ids are errors."""
    filled = plan.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in plan.columns else F.lit(v) for k, v in PLAN.items()})
    older = model.legacy_profile(profiles).select("profile_id", "length", "trend", "seasonality", "anomalies", "noise", "anomaly_threshold", "normal_min", "normal_max", "no_strong_trend_threshold")
    runs = model.with_method(model.with_profile(filled, profiles), methods).join(F.broadcast(older), "profile_id")
    return runs.withColumn("experiment_id", experiment_id(F.col("profile_id"), F.col("method"), F.col("model"), F.when(F.col("batch_id") != "", F.col("batch_id")), F.col("run_id")))


def choose_examples(runs: DataFrame, features: DataFrame, generated: DataFrame) -> DataFrame:
    """experiment_id, position, reference_id, role for all runs whose method shows references."""
    of = lambda m: runs.filter(F.col("method") == m)
    keep = ["experiment_id", "position", "reference_id", "role"]
    picked = examples.random_examples(of("random_few_shot"), features).withColumn("role", F.lit(None).cast("string")).select(keep)
    for found in (examples.anchor_neighbours(of("harmonic_knn"), features), examples.residual_examples(of("tabgen_icl_residual"), features, generated)):
        picked = picked.unionByName(found.withColumn("role", F.lit(None).cast("string")).select(keep))
    return picked.unionByName(examples.role_examples(of("epic_grouped_attribute_few_shot"), features).select(keep))


def with_examples(runs: DataFrame, picked: DataFrame, series: DataFrame, features: DataFrame) -> DataFrame:
    """Adds ``examples`` (texts in order) and ``selected_reference_ids``; a chosen reference without a series is an error."""
    values = series.groupBy("reference_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("values"))
    rows = picked.join(features.select("reference_id", "mean", "std", "trend_slope"), "reference_id").join(values, "reference_id", "left")
    lost = rows.filter("values is null").select("reference_id").limit(1).collect()
    if lost:
        raise ValueError(f"reference {lost[0][0]!r} has no series")
    text = prompts.example_text(F.col("position"), F.col("reference_id"), F.col("values"), F.col("mean"), F.col("std"), F.col("trend_slope"), F.col("role"))
    per = rows.groupBy("experiment_id").agg(F.sort_array(F.collect_list(F.struct("position", text.alias("text"), "reference_id", "role"))).alias("p"))
    per = per.select("experiment_id", F.col("p.text").alias("examples"), F.col("p.reference_id").alias("selected_reference_ids"), F.col("p.role").alias("selected_reference_roles"))
    return runs.join(per, "experiment_id", "left").withColumn("n_examples_selected", F.coalesce(F.when(F.col("examples").isNotNull(), F.size("examples")), F.lit(0)))


_VALIDATION = ("valid_series", "failed_checks", "length", "length_ok", "timestamps_not_null", "values_not_null", "daily_frequency_ok", "range_ok", "values_numeric", "increasing_trend_ok", "decreasing_trend_ok", "no_strong_trend_ok", "weekly_seasonality_ok", "weekly_autocorrelation", "anomaly_count", "anomaly_count_ok", "trend_slope")


def _same(df: DataFrame, name: str) -> DataFrame:
    return df


def judge(attempts: DataFrame, kept: Callable[[DataFrame, str], DataFrame] = _same) -> DataFrame:
    """Attempts with parsing, curation, checks and basic metrics; one that gives no series is ``failed``.

    ``attempts``: attempt_id, raw, status, error_message, value_only and the
    profile columns of ``planned``. An answer whose points are all unusable is
    completed from nothing, like any short one. ``kept`` may write what is read
    several times, parsed answers and final points, and give it back.
    """
    c = F.col
    rows = kept(attempts.withColumn("parsed", parse_series(c("raw"))), "parsed").withColumnRenamed("attempt_id", "series_id")
    ok = F.coalesce((c("status") == "success") & c("parsed.error").isNull(), F.lit(False))
    rows = rows.withColumn("error_message", F.coalesce("error_message", c("parsed.error"))).withColumn("status", F.when(ok, "success").otherwise("failed"))
    good = rows.filter("status = 'success'")
    spec = good.select(
        "series_id", c("length").alias("goal"), c("trend").alias("way"), (c("seasonality") == "weekly").alias("weekly"), c("value_min").alias("low"), c("value_max").alias("high"), c("start_date").alias("start"),
        F.when(c("anomalies") == "point", c("expected_anomalies")).alias("wanted"), c("anomaly_threshold").alias("over"), c("no_strong_trend_threshold").alias("flat"),
    )
    raw = parsed_points(good)
    clean = curate.curate(raw.join(spec.select("series_id", "low", "high"), "series_id"), c("low"), c("high"))
    final = kept(curate.enforce_length(clean, spec), "points")
    checks = validate.validate(final.join(spec, "series_id"), c("goal"), c("low"), c("high"), c("way"), c("weekly"), c("wanted"), c("over"), c("flat"))
    scored = validate.quality_score(checks.join(spec.select("series_id", "way", "weekly", "wanted"), "series_id"), c("way"), c("weekly"), c("wanted"))
    scored = scored.select("series_id", F.struct(*_VALIDATION).alias("validation"), "valid_series", "n_failed_checks", "quality_score")
    basic = metrics.basic_metrics(final).select("series_id", F.struct("mean", "std", "min", "max", "trend_slope", "weekly_autocorrelation", "anomaly_count").alias("metrics"))
    listed = lambda df, name: df.groupBy("series_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias(name))
    out = rows.join(scored, "series_id", "left").join(basic, "series_id", "left").join(clean.groupBy("series_id").agg(F.count("value").alias("curated")), "series_id", "left")
    out = out.join(listed(raw.filter("value is not null"), "values_before_curation"), "series_id", "left").join(listed(final, "values_after_curation"), "series_id", "left")
    n = F.when(c("status") == "success", F.coalesce(c("curated"), F.lit(0)))
    completed, truncated = (F.coalesce(F.greatest(F.lit(0), x), F.lit(0)) for x in (c("length") - n, n - c("length")))
    short = F.when((c("seasonality") == "weekly") & (n >= 7), "weekly_continuation").otherwise("linear_continuation")
    info = F.struct(
        (completed + truncated > 0).alias("length_curation_applied"), n.alias("generated_length_before_curation"), c("length").alias("target_length"), completed.alias("completed_points"), truncated.alias("truncated_points"),
        F.when(truncated > 0, "truncation").when(completed > 0, short).alias("length_curation_strategy"),
    )
    success, kind = parse_status(c("status"), c("parsed"))
    dated = (F.coalesce(c("validation.timestamps_not_null"), F.lit(False)).cast("double") + F.coalesce(c("validation.daily_frequency_ok"), F.lit(False)).cast("double")) / 2
    none = F.array().cast("array<double>")
    out = out.withColumns({
        "structural_curation_info": info, "parse_success": success, "parse_error_type": kind, "timestamp_source": F.when(c("value_only"), "python_postprocess").otherwise("llm_output"),
        "timestamp_score": F.when(c("value_only"), 1.0).otherwise(dated), "values_before_curation": F.coalesce("values_before_curation", none), "values_after_curation": F.coalesce("values_after_curation", none),
        "valid_series": F.coalesce("valid_series", F.lit(False)), "n_failed_checks": F.coalesce("n_failed_checks", F.lit(validate.FAILED_CHECKS)), "quality_score": F.coalesce("quality_score", F.lit(validate.FAILED_SCORE)),
    })
    return out.drop("curated").withColumnRenamed("series_id", "attempt_id")


def scores_of(judged: DataFrame, column: str, profiles: DataFrame, bands: DataFrame) -> DataFrame:
    """attempt_id and the scores of the series in an array column against the attempt's own profile."""
    points = judged.select(F.col("attempt_id").alias("series_id"), "profile_id", F.posexplode(column).alias("pos", "value"))
    facts = judged.select(F.col("attempt_id").alias("series_id"), "profile_id", "parse_success", "timestamp_score")
    found = metrics.profile_metrics(points, profiles, bands, "parse_success", "timestamp_score", facts)
    names = [c for c in found.columns if c not in ("series_id", "profile_id")]
    return found.select(F.col("series_id").alias("attempt_id"), F.struct(*names, F.col("numeric_length").alias("numeric_generated_length"), F.col("invalid_count").alias("invalid_numeric_count")).alias(column))


def _final_attempts(judged: DataFrame, refined: DataFrame) -> DataFrame:
    """The attempt that stands for each run, with what the workflow knows of the others."""
    c = F.col
    of = lambda m: judged.filter(c("method") == m)
    plain = judged.filter(~c("method").isin(REFINE, CANDIDATES))

    first, second = of(REFINE), refined.select("experiment_id", F.struct("*").alias("second"))
    both = first.join(second, "experiment_id", "left")
    fails = F.size("validation.failed_checks")
    better = c("second").isNotNull() & ((c("second.status") == "failed") | c("second.valid_series") | (c("second.n_failed_checks") < fails))
    feedback = F.struct(
        c("second").isNotNull().alias("feedback_applied"), F.when(better, "refined").otherwise("initial").alias("final_attempt_name"), c("valid_series").alias("initial_valid_series"), c("validation.failed_checks").alias("initial_failed_checks"),
        c("second.valid_series").alias("refined_valid_series"), c("second.validation.failed_checks").alias("refined_failed_checks"),
    )
    kept = both.select(*[F.when(better, c(f"second.{x}")).otherwise(c(x)).alias(x) for x in first.columns if x != "experiment_id"], "experiment_id", feedback.alias("feedback"))

    tried = validate.best_candidate(of(CANDIDATES).withColumn("usable", F.col("status") == "success").withColumn("quality_score", F.when(c("usable"), c("quality_score")).otherwise(validate.FAILED_SCORE)), "experiment_id")
    summary = validate.candidate_summary(tried, "experiment_id").select("experiment_id", F.struct("n_candidates", "n_successful_candidates", "n_valid_candidates", "valid_candidates_rate").alias("candidates"), "all_failed")
    best = tried.filter("rank = 1").drop("rank", "usable").join(summary, "experiment_id")
    best = best.withColumn("error_message", F.when(c("all_failed"), "all candidates failed").otherwise(c("error_message"))).drop("all_failed")
    return plain.unionByName(kept, allowMissingColumns=True).unionByName(best, allowMissingColumns=True)


def records(final: DataFrame, profiles: DataFrame, bands: DataFrame) -> DataFrame:
    """Run records in the nested layout that ``flatten_runs`` reads."""
    c = F.col
    rows = final.join(scores_of(final, "values_before_curation", profiles, bands).withColumnRenamed("values_before_curation", "llm"), "attempt_id")
    rows = rows.join(scores_of(final, "values_after_curation", profiles, bands).withColumnRenamed("values_after_curation", "last"), "attempt_id")
    info = c("structural_curation_info")
    changed = (info["completed_points"] + info["truncated_points"]) / F.nullif(c("expected_length"), F.lit(0))
    profile = [x for x in profiles.columns if x != "profile_id"]
    scores = [x for who, at in (("", "llm"), ("llm_", "llm"), ("final_", "last")) for x in [c(f"{at}.{s}").alias(f"{who}{s}") for s in _SCORES]]
    based = F.struct(
        "parse_success", "parse_error_type", "timestamp_source", F.size("values_before_curation").alias("values_before_curation_length"), F.size("values_after_curation").alias("values_after_curation_length"), F.coalesce(changed, F.lit(0.0)).alias("curation_change_rate"), *scores,
        c("llm.final_valid").alias("strict_llm_valid"), c("last.final_valid").alias("curated_series_valid"), c("llm.final_valid").alias("final_valid"), c("llm").alias("llm_output_metrics"), c("last").alias("final_series_metrics"),
    )
    uses = F.coalesce("uses_references", F.lit(False))
    context = F.struct(
        uses.alias("reference_bank_used"), "n_examples_selected", "selected_reference_ids", "selected_reference_roles", "selection_seed", (c("selection_seed") + c("run_id")).alias("effective_seed"),
        *[c(f"feedback.{x}") for x in ("feedback_applied", "final_attempt_name", "initial_valid_series", "initial_failed_checks", "refined_valid_series", "refined_failed_checks")],
        *[c(f"candidates.{x}") for x in ("n_candidates", "n_successful_candidates", "n_valid_candidates", "valid_candidates_rate")],
        F.when(c("candidates").isNotNull(), c("candidate_id")).alias("best_candidate_id"), F.when(c("candidates").isNotNull(), c("quality_score")).alias("best_candidate_quality_score"), F.when(c("candidates").isNotNull(), c("n_failed_checks")).alias("best_candidate_n_failed_checks"),
    )
    return rows.select(
        "experiment_id", "status", "error_message", F.lit("from_scratch").alias("scenario"), "model", "method", "batch_id", "elapsed_time_seconds", F.struct(c("method").alias("method_name"), "method_family").alias("method_metadata"),
        F.struct("temperature", "num_predict", "timeout", "n_examples", "selection_seed", "batch_id").alias("generation_config"), F.struct("profile_id", *profile).alias("structured_profile"), context.alias("context_selection"),
        F.struct(c("parsed.raw_json_valid"), c("parsed.parse_repaired"), c("parsed.repair_type"), c("parsed.error").alias("parse_error"), c("parsed.shape").alias("output_normalization")).alias("parse_info"),
        "structural_curation_info", "validation", "metrics", based.alias("profile_based_metrics"), "values_before_curation", "values_after_curation", "prompt", "raw",
    )


def final_points(done: DataFrame) -> DataFrame:
    """series_id (the experiment_id), pos, ts, value of the records' final series."""
    rows = done.select(F.col("experiment_id").alias("series_id"), F.col("structured_profile.profile_id").alias("profile_id"), F.col("structured_profile.start_date").alias("start"), F.posexplode("values_after_curation").alias("pos", "value"))
    return curate.on_daily_grid(rows, F.col("start")).drop("start")


def earlier_features(done: DataFrame, profiles: DataFrame) -> DataFrame:
    """What the residual choice may look at of finished runs: their records joined with their series."""
    runs = done.select("experiment_id", "status", "method", "model", "batch_id", F.col("structured_profile.profile_id").alias("profile_id"), F.col("validation.valid_series").alias("valid_series"))
    return examples.generated_features(bank.series_features(final_points(done), profiles).drop("profile_id"), runs)


def features_from_files(flat: DataFrame, points: DataFrame, profiles: DataFrame) -> DataFrame:
    """The same from flat run records and series as read from files (series_id is the experiment_id); runs without a series drop out."""
    dated = curate.with_positions(points.select("series_id", "ts", "value")).join(flat.select(F.col("experiment_id").alias("series_id"), "profile_id"), "series_id")
    return examples.generated_features(bank.series_features(dated, profiles).drop("profile_id"), flat)


def run_experiments(
    spark: SparkSession, plan: DataFrame, series: DataFrame, features: DataFrame, generator: Generator, store: str, earlier: DataFrame | None = None, profiles: DataFrame | None = None, parallel: int = 8, attempts: int = 1,
) -> DataFrame:
    """Records of all planned runs. ``series`` and ``features`` are the reference bank, ``earlier`` records of finished runs.

    ``store`` is a folder that all nodes share; answers and judged attempts are
    written there.
    """
    c = F.col
    profiles = model.profiles(spark) if profiles is None else profiles
    bands, methods = model.noise_bands(spark), model.methods(spark)

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{store}/{name}")
        return spark.read.schema(df.schema).parquet(f"{store}/{name}")

    def answered(rows: DataFrame, name: str) -> DataFrame:
        answers = kept(generate(rows.select("attempt_id", "prompt"), generator, parallel, attempts), f"{name}-answers")
        judged = judge(rows.join(answers.drop("prompt"), "attempt_id"), lambda df, what: kept(df, f"{name}-{what}"))
        return kept(judged, f"{name}-judged")

    runs = planned(plan, profiles, methods)
    if earlier is None:
        known = spark.createDataFrame([], "experiment_id string, profile_id string, model string, batch_id string, mean double, std double, trend_slope double, weekly_autocorrelation double, anomaly_count double")
    else:
        known = earlier_features(earlier, profiles)
    picked = kept(choose_examples(runs, features, known), "examples")
    runs = kept(prompts.build_prompts(with_examples(runs, picked, series, features)), "planned")
    single = runs.filter(c("method") != CANDIDATES).withColumn("candidate_id", F.lit(None).cast("int"))
    several = runs.filter(c("method") == CANDIDATES).withColumn("candidate_id", F.explode(F.sequence(F.lit(1), c("n_examples"))))
    several = several.withColumn("prompt", prompts.candidate_prompt(c("candidate_id"), c("n_examples")))
    first = single.unionByName(several).withColumn("attempt_id", F.concat_ws("#", "experiment_id", F.coalesce(c("candidate_id").cast("string"), F.lit("initial"))))
    judged = answered(first, "initial")
    again = judged.filter((c("method") == REFINE) & (c("status") == "success") & ~c("valid_series"))
    feedback = prompts.feedback_text(c("validation.failed_checks"), c("validation.trend_slope"), c("validation.weekly_autocorrelation"), c("validation.anomaly_count"))
    second = again.withColumn("prompt", prompts.refinement_prompt(c("values_after_curation"), feedback)).select(first.columns).withColumn("attempt_id", F.concat_ws("#", "experiment_id", F.lit("refined")))
    return kept(records(_final_attempts(judged, answered(second, "refined")), profiles, bands), "records")
