"""Every registered query of the library against its DuckDB SQL, and edge cases on literal vectors."""

import http.server
import json
import random
import statistics
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom import model
from seriesloom.functions import columns as c
from seriesloom.functions.parsing import parse_one
from seriesloom.operators import bank, curate, examples, metrics, prompts, rollup, run_columns, select, validate, workflow
from seriesloom.plans import catalogue
from seriesloom.sources import generator
from tests.compare import connection, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, con, name):
    assert difference(spark, SF, catalogue.queries()[name], catalogue.oracle_sql()[name], con) == ""


def points(spark, **series):
    rows = [(k, i, None if v is None else float(v)) for k, vs in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "series_id string, pos int, value double")


def scores(spark, profile, **series):
    p = model.profiles(spark).filter(F.col("profile_id") == profile)
    return {r["series_id"]: r for r in metrics.profile_metrics(points(spark, **series), p, model.noise_bands(spark)).collect()}


def test_scores_of_short_constant_and_missing(spark):
    got = scores(spark, "P4_30", one=[5], two=[3, 1], constant=[7.0] * 30, falling=list(range(40, 10, -1)), gaps=[1, None, float("nan"), 4, 5], none=[None, None])
    assert got["one"]["trend_score"] == 0.0 and got["two"]["trend_score"] == 1.0
    assert got["constant"]["trend_score"] == 0.0 and got["constant"]["detected_anomalies"] == 0
    assert got["falling"]["trend_score"] == pytest.approx(1.0) and got["falling"]["length_score"] == 1.0
    assert got["gaps"]["numeric_length"] == 3 and got["gaps"]["invalid_count"] == 2 and got["gaps"]["numeric_validity_score"] == pytest.approx(0.6)
    assert got["none"]["range_score"] == 0.0 and got["none"]["numeric_validity_score"] == 0.0
    for r in got.values():
        assert all(0 <= r[k] <= 1 for k in r.asDict() if k.endswith("_score"))


def test_weekly_spike_is_found(spark):
    week = [100, 120, 140, 130, 110, 90, 80]
    v = [x + (i * 7919 % 5) for i, x in enumerate(week * 4)]
    v[10] = 500
    got = scores(spark, "P2_28", a=v)["a"]
    # the spike shifts its phase's mean, so the other three points of that phase stand out too
    assert got["detected_anomalies"] == 4 and got["anomaly_score"] == 0.0


def test_period_means_are_added_in_order_when_sorts_spill(spark):
    draw = random.Random(1)
    v = {f"s{k}": [draw.randrange(1, 9999) / 100 for _ in range(28)] for k in range(20)}
    variant = spark.createDataFrame([(True, 7, 0.0, 1000.0)], "seasonal boolean, lag int, value_min double, value_max double")
    conf, name = spark._jvm.org.apache.spark.SparkEnv.get().conf(), "spark.shuffle.spill.numElementsForceSpillThreshold"
    conf.set(name, "5")
    try:
        got = metrics._with_trend_points(metrics.residual_table(points(spark, **v).crossJoin(variant))).filter("v is not null").select("series_id", F.col("at").cast("int"), "v").collect()
    finally:
        conf.remove(name)
    want = {}
    for k, xs in v.items():
        for i, x in enumerate(xs):
            want[k, i // 7] = want.get((k, i // 7), 0.0) + x
    assert {(k, at): m for k, at, m in got} == {at: total / 7 for at, total in want.items()}


def test_range_bounds_are_inclusive(spark):
    assert scores(spark, "P1_20", a=[0, 1000, 1000.5])["a"]["out_of_range_count"] == 1


@pytest.mark.parametrize(("text", "want"), [("1_0", 10.0), ("12d", None), ("nan", None), ("1e3", 1000.0), ("", None), (None, None), (" -2.5 ", -2.5)])
def test_numbers_from_text(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(c.to_number(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(
    ("text", "repair", "vals"),
    [
        ("[1, 2]", None, [1, 2]), ("[1, 2", "added_closing_bracket", [1, 2]), ("so [1,2] there", "extracted_json_array_from_text", [1, 2]), ("[1] and [2]", "extracted_numeric_values_from_text", [1, 2]),
        ('[{"timestamp": "2024-01-05", "value": 1}, {"timest', "extracted_numeric_values_from_text", [2024, -1, -5, 1]), ('{"values": [1]}', None, [1]), ('{"output": {"values": [2]}}', None, [2]), ("[[1, 2]]", None, [1, 2]), ('[{"v": 1}]', None, [1]),
    ],
)
def test_parsing(text, repair, vals):
    got = parse_one(text)
    assert got[2] == repair and got[3] is None and got[7] == vals


@pytest.mark.parametrize("text", ['[{"a": 1, "b": 2}]', "5", "", None, "no numbers"])
def test_parsing_errors_are_rows(text):
    got = parse_one(text)
    assert got[3] and got[7] is None


def test_curation(spark):
    rows = spark.createDataFrame([("a", 0, "2024-01-02", 5.0), ("a", 1, "2024-01-02", 6.0), ("a", 2, "2024-01-01", 2000.0), ("a", 3, None, 1.0), ("a", 4, "2024-01-03", None)], "series_id string, src_pos int, ts string, value double")
    got = curate.curate(rows.withColumn("ts", F.col("ts").cast("date")), F.lit(0.0), F.lit(1000.0)).orderBy("pos").collect()
    assert [(r["pos"], r["value"]) for r in got] == [(0, 1000.0), (1, 5.0)]


def test_completed_series_have_the_target_length(spark):
    p = points(spark, a=[1, 2, 3], b=range(10), c=range(40), d=[9]).withColumn("ts", F.date_add(F.lit("2024-01-01").cast("date"), "pos"))
    for weekly in (True, False):
        specs = curate.specs_of(p, 30, "decreasing", weekly).unionByName(curate.specs_of(p.limit(1).withColumn("series_id", F.lit("nothing")), 30, "decreasing", weekly))
        got = curate.enforce_length(p, specs).groupBy("series_id").agg(F.count("value").alias("n"), F.min_by("value", "pos").alias("first"), F.count_distinct("ts").alias("days")).collect()
        assert {(r["n"], r["days"]) for r in got} == {(30, 30)} and len(got) == 5
        assert {r["series_id"]: r["first"] for r in got}["nothing"] == 99.0  # a step down from 100


def test_checks(spark):
    p = points(spark, up=range(30), flat=[5] * 30).withColumn("ts", F.date_add(F.lit("2024-01-01").cast("date"), "pos"))
    got = {r["series_id"]: r["failed_checks"] for r in validate.validate(p, 30, 0, 1000, "increasing").collect()}
    assert got == {"up": [], "flat": ["increasing_trend_ok"]}


def test_bank_is_deterministic_and_has_its_features(spark):
    p = model.profiles(spark)
    a, b = bank.generate_bank(p, 3), bank.generate_bank(p.repartition(5), 3)
    assert a.exceptAll(b).isEmpty() and a.count() == 3 * (20 + 28 + 28 + 30 + 60 + 60)
    f = bank.bank_features(a, p)
    assert len(f.columns) == 20 and f.count() == 18
    assert f.filter("profile_id = 'P4_30' and trend_slope >= 0").isEmpty()


def test_unknown_profile(spark):
    with pytest.raises(ValueError, match="unknown"):
        model.with_profile(spark.createDataFrame([("P9",)], "profile_id string"), model.profiles(spark))


def test_flat_runs_have_all_columns(spark, tmp_path):
    (tmp_path / "a_metrics.json").write_text('{"experiment_id": "P1_20_m_x_run3", "status": "success", "structured_profile": {"profile_id": "P1_20"}, "validation": {"failed_checks": ["a", "b"], "length_ok": true}, "parse_info": {"raw_json_valid": true}}')
    (tmp_path / "b_metrics.json").write_text("{broken")
    from seriesloom.sources.files import read_runs

    flat = rollup.flatten_runs(read_runs(spark, f"{tmp_path}/*_metrics.json"))
    row = flat.collect()
    assert len(flat.columns) == 175 and len(row) == 1
    assert (row[0]["run_id"], row[0]["failed_checks"], row[0]["raw_json_valid"], row[0]["source_file"]) == (3, "a|b", True, "a_metrics.json")
    assert len(rollup.aggregates(rollup.derived_flags(flat).columns)) == 47


def test_every_run_has_its_previous_runs_counted(spark):
    runs = [(f"r{i}", None if i % 7 == 0 else "success" if i % 3 else "failed", "ab"[i % 2], "m" if i % 5 else None, "b1" if i % 4 else None, "xyz"[i * i % 3] if i % 11 else None) for i in range(60)]
    df = spark.createDataFrame([*runs, runs[8], (None, *runs[9][1:])], "experiment_id string, status string, profile_id string, model string, batch_id string, method string")
    for model_too in (True, False):
        for batch_too in (True, False):
            want = rollup.previous_runs(df, df, model_too, batch_too).groupBy("for_experiment_id").count()
            got = rollup.previous_run_counts(df, model_too, batch_too)
            assert sorted(map(str, got.collect())) == sorted(str(r).replace("count=", "n=") for r in want.collect())


def test_streaming_rollup(spark, tmp_path):
    from seriesloom.streaming.rollup import current, start

    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "k string, v double")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    start(stream, ["k"], "v", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    got = {r["k"]: (r["n"], r["mean"], r["std"]) for r in current(spark, f"{tmp_path}/out", ["k"]).collect()}
    assert got["a"] == (2, 2.0, pytest.approx(2**0.5)) and got["b"] == (1, 5.0, None)


def test_all_aggregates(spark):
    names = [n for n, _, _ in rollup.AGGREGATES]
    inputs = sorted({i for _, i, _ in rollup.AGGREGATES})
    rows = [("a", "success" if k % 3 else None, *[float((k * 7 + j * 3) % 11) if (k + j) % 4 else None for j, _ in enumerate(inputs)]) for k in range(40)]
    df = spark.createDataFrame(rows, "experiment_id string, status string, " + ", ".join(f"`{i}` double" for i in inputs))
    got = df.agg(*rollup.aggregates(df.columns)).first()
    assert got["n_runs"] == 40 and got["success_rate"] == pytest.approx(sum(r[1] is not None for r in rows) / 40) and len(names) == len(set(names)) == 45
    for name, source, kind in rollup.AGGREGATES:
        x = [r[2 + inputs.index(source)] for r in rows if r[2 + inputs.index(source)] is not None]
        assert got[name] == pytest.approx(statistics.stdev(x) if kind == "std" else statistics.mean(x)), name


def test_all_columns_of_a_run(spark, tmp_path):
    """Every field of a record arrives under its flat name."""
    record: dict = {}
    for k, (_, path, kind) in enumerate(run_columns.COLUMNS):
        *blocks, field = path.split(".")
        at = record
        for b in blocks:
            at = at.setdefault(b, {})
        at[field] = {"text": f"t{k}", "number": k + 0.5, "flag": k % 2 == 0, "check": k % 2 == 0, "list": [f"x{k}", "y"]}[kind]
    (tmp_path / "r_metrics.json").write_text(json.dumps(record))
    from seriesloom.sources.files import read_runs

    row = rollup.flatten_runs(read_runs(spark, f"{tmp_path}/*.json")).first()
    for k, (name, path, kind) in enumerate(run_columns.COLUMNS):
        k = next(i for i, x in reversed(list(enumerate(run_columns.COLUMNS))) if x[1] == path)  # noqa: PLW2901  a field may be read twice
        assert row[name] == {"text": f"t{k}", "number": k + 0.5, "flag": k % 2 == 0, "check": k % 2 == 0, "list": f"x{k}|y"}[kind], name


# Printed reference series of P4_30, their first values.
GOLDEN = {"P4_30_ref_026": [220.34, 213.92, 219.55, 211.92, 196.68], "P4_30_ref_013": [204.7, 207.13, 205.9, 198.04, 199.8], "P4_30_ref_005": [202.78, 195.87, 197.3, 191.64, 185.29]}


def test_numpy_bank_repeats_printed_series(spark):
    p = model.profiles(spark)
    series = bank.numpy_bank(spark).cache()
    got = series.groupBy("reference_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("v")).filter(F.col("reference_id").isin(list(GOLDEN))).collect()
    assert {r["reference_id"]: r["v"][:5] for r in got} == GOLDEN and {len(r["v"]) for r in got} == {30}
    features = {r["reference_id"]: r for r in bank.bank_features(series, p).filter("profile_id = 'P4_30'").collect()}
    assert [round(features["P4_30_ref_026"][c], 2) for c in ("mean", "std")] == [156.28, 39.42] and round(features["P4_30_ref_026"]["trend_slope"], 3) == -4.536
    assert [round(features["P4_30_ref_013"][c], 2) for c in ("mean", "std")] == [161.06, 28.69] and round(features["P4_30_ref_013"]["trend_slope"], 3) == -3.289
    # flat profiles keep within their threshold, spikes are where they are asked for
    assert series.filter("profile_id = 'P3_28' and value >= 200").groupBy("reference_id").count().agg(F.min("count")).first()[0] >= 2


def test_exact_quantiles(spark):
    rng = random.Random(1)
    for values in ([5.0], [1.0, 2.0], [3.0] * 50, [rng.choice((rng.random(), 7.0)) for _ in range(4001)], [None, 2.0, float("nan"), 1.0]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        known = [v for v in values if v is not None and v == v]
        shares = [0.0, 0.2, 0.5, 0.83, 1.0]
        for most in (10**6, 5):
            assert select.exact_quantiles(df, "x", shares, most) == pytest.approx(list(np.quantile(known, shares)))
    assert select.exact_quantiles(spark.createDataFrame([], "x double"), "x", [0.5]) == [None]


def test_distances_of_odd_inputs(spark):
    ref = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    cand = spark.createDataFrame([("a", 2.0), ("b", 3.0), ("c", None)], "g string, x double")
    assert {r["g"]: r["distance"] for r in select.js_distance(ref, cand, "x", ["g"]).collect()} == {"a": 0.0, "b": 1.0, "c": 1.0}
    ref = spark.createDataFrame([(float(i),) for i in range(20)], "x double")
    got = {r["g"]: r["distance"] for r in select.js_distance(ref, cand, "x", ["g"]).collect()}
    assert got["c"] == 1.0 and 0 < got["a"] < 1


def test_failed_attempts_come_last(spark):
    p = points(spark, up=range(30), flat=[5] * 30).withColumn("ts", F.date_add(F.lit("2024-01-01").cast("date"), "pos"))
    rows = validate.validate(p, 30, 0.0, 1000.0, "increasing").withColumn("status", F.when(F.col("series_id") == "up", "failed").otherwise("success"))
    got = {r["series_id"]: r for r in validate.quality_score(rows, "increasing", False, None, status=F.col("status")).collect()}
    assert (got["up"]["quality_score"], got["up"]["n_failed_checks"], got["up"]["valid_series"]) == (-9999.0, 999, False) and got["flat"]["quality_score"] == 15 - 15 - 10


def test_sinks(spark, tmp_path):
    from seriesloom.sources import files

    rows = spark.sql("select 'a' id, cast('NaN' as double) x, array(1D, cast('Infinity' as double)) xs, named_struct('y', cast('NaN' as double), 'm', map('k', cast('NaN' as double))) s, cast(null as struct<z: double>) n")
    files.write_runs(rows, f"{tmp_path}/runs")
    text = "".join(f.read_text() for f in (tmp_path / "runs").glob("part-*"))
    assert json.loads(text) == {"id": "a", "x": None, "xs": [1.0, None], "s": {"y": None, "m": {"k": None}}, "n": None}
    p = points(spark, up=range(3), down=[3, None, 1]).withColumn("ts", F.date_add(F.lit("2024-01-01").cast("date"), "pos").cast("timestamp_ntz"))
    files.write_series_csv(p, f"{tmp_path}/series", 2)
    assert sorted(map(str, files.read_written_series(spark, f"{tmp_path}/series").collect())) == sorted(map(str, p.select("series_id", "ts", "value").collect()))
    p.filter("series_id = 'up'").select(F.col("ts").alias("timestamp"), "value").coalesce(1).write.csv(f"{tmp_path}/one", header=True)
    assert files.read_series_csv(spark, f"{tmp_path}/one/*.csv").agg(F.sum("value")).first()[0] == 3.0
    texts = spark.createDataFrame([("e1", "line\n\"two\""), ("e2", None)], "experiment_id string, prompt string")
    files.write_texts(texts, f"{tmp_path}/prompts", "prompt")
    assert sorted(map(str, map(tuple, files.read_texts(spark, f"{tmp_path}/prompts").collect()))) == sorted(map(str, map(tuple, texts.collect())))
    (tmp_path / "e1_raw_output.txt").write_text("[1]\n")
    assert files.read_raw_outputs(spark, f"{tmp_path}/*.txt").first()["series_id"] == "e1"
    rolled = spark.createDataFrame([(0, "b", "m2", 1.0), (0, "b", "m1", 2.0), (4, "b", None, 1.5)], "level int, batch_id string, model string, success_rate double")
    files.write_rollups(rolled, f"{tmp_path}/rolled")
    back = spark.read.csv(f"{tmp_path}/rolled", header=True)
    assert back.count() == 3 and [r["model"] for r in back.filter("level = 0").collect()] == ["m1", "m2"]
    files.write_run_summary(rolled, f"{tmp_path}/summary")
    assert spark.read.csv(f"{tmp_path}/summary", header=True).count() == 3
    with pytest.raises(FileExistsError):
        files.not_yet_run(texts, texts.limit(1))
    assert files.not_yet_run(texts, texts, overwrite=True).count() == 2
    made = bank.generate_bank(model.profiles(spark), 2)
    files.write_bank(made, bank.bank_features(made, model.profiles(spark)), f"{tmp_path}/bank")
    assert files.read_features(spark, f"{tmp_path}/bank/features", "P1_20").count() == 2
    with pytest.raises(ValueError, match="no reference features"):
        files.read_features(spark, f"{tmp_path}/bank/features", "P9")


def test_generator_retries_and_records_failures(spark):
    def flaky():
        calls = {}

        def ask(prompt):
            calls[prompt] = calls.get(prompt, 0) + 1
            if prompt == "never" or calls[prompt] < 2:
                raise OSError("down")
            return prompt.upper()

        return ask

    rows = spark.createDataFrame([("a",), ("never",)], "prompt string")
    got = {r["prompt"]: r for r in generator.generate(rows, flaky, 1, attempts=3, wait=0.01).collect()}
    assert (got["a"]["raw"], got["a"]["status"], got["a"]["error_message"]) == ("A", "success", None)
    assert (got["never"]["raw"], got["never"]["status"], got["never"]["error_message"]) == (None, "failed", "OSError: down")
    assert generator.generate(rows, generator.replay({"a": "[1]"}), 2).filter("raw = '[1]'").count() == 1


def test_prompts_of_all_methods(spark):
    plan = spark.createDataFrame([(p[0], m[0], "m", "b", 1) for p in model.PROFILES for m in model.METHODS], "profile_id string, method string, model string, batch_id string, run_id int")
    runs = workflow.planned(plan, model.profiles(spark), model.methods(spark)).withColumn("examples", F.when(F.col("uses_references"), F.array(F.lit("EXAMPLE"))))
    got = prompts.build_prompts(runs).collect()
    assert len({(r["profile_id"], r["prompt"]) for r in got}) == 66
    for r in got:
        assert f"{r['length']} values" in r["prompt"] and ("timestamp" in r["prompt"]) != r["value_only"] and ("EXAMPLE" in r["prompt"]) == r["uses_references"]
        assert ("made-up example" in r["prompt"]) == (r["method"] == "canonical_few_shot")
    kinds = {r["profile_id"]: r["k"] for r in runs.select("profile_id", prompts.pattern().alias("k")).distinct().collect()}
    assert kinds == {"P1_20": "level", "P2_28": "weekly", "P3_28": "rising_weekly_spikes", "P4_30": "falling", "P5_60": "weekly", "P6_60": "rising_weekly_spikes"}
    a = runs.filter("method = 'chatts_attribute_prompting' and profile_id = 'P3_28'").select(prompts.attributes().alias("a")).first()["a"]
    assert (a["trend_attribute"]["type"], a["periodicity_attribute"]["period"], a["local_fluctuation_attribute"]["expected_count"], a["noise_attribute"]["type"]) == ("increasing", 7, 2, "medium")
    with pytest.raises(ValueError, match="unknown method"):
        workflow.planned(plan.withColumn("method", F.lit("x")), model.profiles(spark), model.methods(spark))


def test_run_driver(spark, tmp_path):
    """All methods from plan to record, with an offline generator; then a second batch that sees the first."""
    p = model.profiles(spark)
    series = bank.generate_bank(p, 8).cache()
    features = bank.bank_features(series, p).cache()
    good = {"P1_20": [100 + (i * 7 % 3) for i in range(20)], "P4_30": [240 - 4 * i + (i * 5 % 4) for i in range(30)], "P2_28": [100 + (20, 30, 40, 35, 10, 0, 5)[i % 7] for i in range(28)]}

    def maker():
        def ask(prompt):
            pid = "P1_20" if "20 values" in prompt else "P4_30" if "30 values" in prompt else "P2_28"
            if "answer 2 of" in prompt:
                raise TimeoutError("late")
            if "answer 3 of" in prompt or "Your last answer was" in prompt:
                return json.dumps(good[pid])
            if "will be checked" in prompt:
                return json.dumps(list(range(25)))  # wrong in several ways, so it is refined
            if "timestamp" in prompt:
                return "Here: " + json.dumps([{"timestamp": f"2024-01-{i + 1:02}", "value": v} for i, v in enumerate(good[pid])])
            return json.dumps(good[pid][:-3]) if "level" in prompt and pid == "P2_28" else "sorry" if pid == "P2_28" and "drawn at random" in prompt else json.dumps(good[pid])

        return ask

    plan = spark.createDataFrame([(pid, m[0], "a model", "b1", 1, 3) for pid in good for m in model.METHODS], "profile_id string, method string, model string, batch_id string, run_id int, n_examples int")
    done = workflow.run_experiments(spark, plan, series, features, maker, f"{tmp_path}/one").cache()
    got = {r["experiment_id"]: r for r in done.collect()}
    assert len(got) == 33 and all(k == f"{r['structured_profile']['profile_id']}_{r['method']}_a_model_b1_run1" for k, r in got.items())
    for r in got.values():
        based, pid = r["profile_based_metrics"], r["structured_profile"]["profile_id"]
        if r["method"] == "random_few_shot" and pid == "P2_28":
            assert r["status"] == "failed" and based["parse_error_type"] == "no JSON and no numbers in the text" and based["parse_success"] == 0 and not based["strict_llm_valid"] and r["values_after_curation"] == []
            continue
        assert r["status"] == "success" and len(r["values_after_curation"]) == len(good[pid]) and based["final_series_metrics"]["length_score"] == 1.0
        assert (r["context_selection"]["n_examples_selected"] == 3) == (r["method"] in ("random_few_shot", "harmonic_knn", "tabgen_icl_residual", "epic_grouped_attribute_few_shot"))
        if r["method"] == "prompt_only":
            assert based["timestamp_source"] == "llm_output" and r["parse_info"]["repair_type"] == "extracted_json_array_from_text"
            assert r["validation"]["valid_series"] == (r["validation"]["failed_checks"] == []) and r["values_after_curation"] == [float(v) for v in good[pid]]
        if r["method"] == "validator_feedback_refinement":
            c = r["context_selection"]
            assert c["feedback_applied"] and c["initial_valid_series"] is False and c["final_attempt_name"] == "refined" and r["values_after_curation"] == [float(v) for v in good[pid]]
        if r["method"] == "cllm_generate_curate":
            c = r["context_selection"]
            assert (c["n_candidates"], c["n_successful_candidates"]) == (3, 2) and c["valid_candidates_rate"] == pytest.approx(c["n_valid_candidates"] / 3)
    flat = rollup.derived_flags(rollup.flatten_runs(rollup.as_read(done)))
    rolled = rollup.roll_up(flat, [("batch_id", "model")]).first()
    assert rolled["n_runs"] == 33 and rolled["success_rate"] == pytest.approx(32 / 33) and 0 < rolled["mean_llm_profile_compliance_score"] < 1
    written = workflow.final_points(done).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    from_files = workflow.features_from_files(rollup.flatten_runs(rollup.as_read(done)), written, p)
    rows = lambda df: sorted(str([r["experiment_id"], *[None if r[c] is None else round(r[c], 9) for c in examples.FEATURES]]) for r in df.collect())
    assert rows(from_files) == rows(workflow.earlier_features(done, p)) != []
    again = plan.filter("method = 'tabgen_icl_residual'").withColumn("run_id", F.lit(2))
    second = workflow.run_experiments(spark, again, series, features, maker, f"{tmp_path}/two", earlier=done)
    assert second.filter("status = 'success'").count() == 3
    requests = workflow.planned(again, p, model.methods(spark))
    info = examples.selection_info(requests, examples.residual_examples(requests, features, workflow.earlier_features(done, p))).collect()
    assert all(r["fallback_reason"] is None and r["n_candidate_subsets"] > 3 and len(r["candidate_scores_summary"]) <= 5 and r["n_examples_selected"] == 3 for r in info)
    alone = examples.selection_info(requests, examples.residual_examples(requests.withColumn("model", F.lit("other")), features, workflow.earlier_features(done, p))).collect()
    assert {r["fallback_reason"] for r in alone} == {"no_previous_generated_series"}


def test_failing_runs_are_rows(spark, tmp_path):
    p = model.profiles(spark)
    series = bank.generate_bank(p, 4)

    def down():
        def ask(prompt):
            raise ConnectionError("no server")

        return ask

    plan = spark.createDataFrame([("P1_20", m, "m", "", 1) for m in ("prompt_only", "cllm_generate_curate", "validator_feedback_refinement")], "profile_id string, method string, model string, batch_id string, run_id int")
    got = {r["method"]: r for r in workflow.run_experiments(spark, plan, series, bank.bank_features(series, p), down, f"{tmp_path}/x").collect()}
    assert {r["status"] for r in got.values()} == {"failed"} and got["cllm_generate_curate"]["error_message"] == "all candidates failed"
    assert got["prompt_only"]["error_message"] == "ConnectionError: no server" and got["prompt_only"]["experiment_id"] == "P1_20_prompt_only_m_run1"


def test_roles_and_fillers(spark):
    refs = spark.createDataFrame([("p", f"r{i}", float(i), float(i), float(i), None, None) for i in range(3)], "profile_id string, reference_id string, mean double, std double, trend_slope double, weekly_autocorrelation double, anomaly_count double")
    req = spark.createDataFrame([("e", "p", 1, 42, 9, "none", "weekly", "point", 2)], "experiment_id string, profile_id string, run_id int, selection_seed int, n_examples int, trend string, seasonality string, anomalies string, expected_anomalies int")
    got = examples.role_examples(req, refs).orderBy("position").collect()
    assert [r["role"] for r in got] == ["stable_trend_attribute", "periodicity_attribute", "local_fluctuation_attribute"] and len({r["reference_id"] for r in got}) == 3
    assert got[1]["score"] == 0.0 and got[0]["description"]  # without any value all scores count as 0
    with pytest.raises(ValueError, match="no feature"):
        examples.anchor_neighbours(req, refs.select("profile_id", "reference_id", *[F.lit(None).cast("double").alias(c) for c in examples.FEATURES]))


def test_windowed_stream(spark, tmp_path):
    from seriesloom.streaming.rollup import windowed

    rows = spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'a' k, 1D v union all select timestamp'2024-01-01 00:50:00', 'a', 2D union all select timestamp'2024-01-09 05:00:00', 'a', 4D")
    rows.write.parquet(f"{tmp_path}/in")
    stream = windowed(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "ts", "k", "v")
    run = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted((str(r["window"]["start"])[:10], r["n"], r["total"]) for r in spark.table("windows").collect()) == [("2024-01-01", 2, 3.0), ("2024-01-09", 1, 4.0)]


def test_http_generator():
    asked = []

    class Server(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            asked.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"response": "[1, 2]"}).encode())

        def log_message(self, *args):
            pass

    with http.server.HTTPServer(("127.0.0.1", 0), Server) as server:
        threading.Thread(target=server.handle_request, daemon=True).start()
        ask = generator.http(f"http://127.0.0.1:{server.server_port}/", "some model", 0.1, 99, 5)()
        assert ask("write") == "[1, 2]"
    assert asked == [{"model": "some model", "prompt": "write", "stream": False, "options": {"temperature": 0.1, "num_predict": 99}}]


def test_report_order(spark):
    rows = [("a", 0.5, 0.1, 0.2), ("b", 0.5, 0.3, 0.9), ("c", None, 0.9, 0.1), ("d", 0.5, 0.3, 0.1), ("e", 0.9, None, None)]
    got = rollup.report(spark.createDataFrame(rows, "k string, mean_llm_profile_compliance_score double, strict_llm_valid_rate double, length_curation_rate double")).collect()
    assert [r["k"] for r in got] == ["e", "d", "b", "a", "c"]
