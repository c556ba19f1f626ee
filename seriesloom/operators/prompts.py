"""Prompt texts as projections of profile columns, in this library's own words.

All functions give columns over rows with the structured profile's columns and
those of ``model.legacy_profile`` (length, trend, seasonality, anomalies, noise,
anomaly_threshold, normal_min, normal_max), so prompts of all runs and methods
are made in one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHECK_TEXTS = {
    "length_ok": "it has the wrong number of values", "timestamps_not_null": "some time stamps are missing", "values_not_null": "some values are missing", "values_numeric": "some values are no numbers",
    "range_ok": "some values lie outside the allowed range", "daily_frequency_ok": "time stamps are not one day apart (only values are asked for, time stamps are added later)",
    "increasing_trend_ok": "it does not rise over the whole time", "decreasing_trend_ok": "it does not fall over the whole time", "no_strong_trend_ok": "it drifts up or down, though its level should stay",
    "weekly_seasonality_ok": "no rhythm of seven days can be seen", "anomaly_count_ok": "it has the wrong number of spikes",
}
#: Further answers by candidate, for each kind of pattern; others get the last text.
VARIATIONS = {
    "spikes": ("Put the spikes far apart.", "Put the spikes at other places than the first answer does.", "Make the spikes clearly higher than all other values.", "Keep trend and rhythm between the spikes.", "Let each spike be a single day."),
    "rising_weekly": ("Use moderate swings within the week.", "Rise a little faster and keep the week's shape.", "Add small changes from day to day.", "Start from another level.", "Keep the noise small."),
    "falling": ("Fall evenly.", "Fall a little faster.", "Add small changes from day to day.", "Start from another level.", "Keep the noise small."),
    "weekly": ("Let all weeks have nearly the same mean.", "Let the same days of the week be alike.", "Use another level.", "Use a wider swing within the week.", "Keep the noise small."),
    "rising": ("Rise evenly.", "Rise a little faster.", "Add small changes from day to day.", "Start from another level.", "Keep the noise small."),
    "level": ("Stay near the middle of the range.", "Use a slightly higher level.", "Use a slightly lower level.", "Vary the values more from day to day.", "Keep changes from day to day small."),
}
OTHER_VARIATION = "Differ from the other answers."
_WEEK = (96.0, 118.0, 137.0, 129.0, 108.0, 91.0, 79.0)


def _prototype(step: float, weekly: bool, spikes: tuple[int, ...] = (), start: float = 100.0) -> list[float]:
    """Two weeks of a hand-made pattern."""
    return [round((_WEEK[i % 7] if weekly else start) + step * (i // 7 if weekly else i) + (140.0 if i in spikes else 0.0) + (i * 5 % 3 - 1) * 0.8, 1) for i in range(14)]


CANONICAL = {
    "rising_weekly_spikes": _prototype(9.0, True, (4, 10)), "spikes": _prototype(0.0, False, (4, 10)), "rising_weekly": _prototype(9.0, True), "weekly": _prototype(0.0, True),
    "rising": _prototype(4.0, False), "falling": _prototype(-4.0, False, start=190.0), "level": _prototype(0.0, False),
}


def pattern() -> Column:
    """Which of the seven kinds of pattern a profile asks for."""
    c = F.col
    weekly, rising, falling, point = c("seasonality") == "weekly", c("trend") == "increasing", c("trend") == "decreasing", c("anomalies") == "point"
    return F.when(point & rising & weekly, "rising_weekly_spikes").when(point, "spikes").when(rising & weekly, "rising_weekly").when(weekly, "weekly").when(rising, "rising").when(falling, "falling").otherwise("level")


def _by(key: Column, texts: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in texts.items() for x in kv]), key)


def task_text() -> Column:
    return F.format_string("Write a daily time series of %d values from %s, each between %.0f and %.0f.", F.col("length").cast("int"), "start_date", "value_min", "value_max")


def pattern_text() -> Column:
    """Trend, seasonality, anomalies and noise as lines in a fixed order."""
    return F.concat_ws(
        "\n", F.concat(F.lit("- Trend: "), "trend_expected"), F.concat(F.lit("- Seasonality: "), "seasonality_expected"),
        F.format_string("- Anomalies: %d", "expected_anomalies"), F.concat(F.lit("- Noise: "), "noise_expected"),
    )


def rules_text() -> Column:
    """The same as explicit rules."""
    c = F.col
    return F.concat_ws(
        "\n", F.format_string("- Give exactly %d values, one for each day without gaps.", c("length").cast("int")), F.format_string("- No value may lie below %.0f or above %.0f.", "value_min", "value_max"),
        F.when(c("trend") == "increasing", "- The level must rise over the whole time.").when(c("trend") == "decreasing", "- The level must fall over the whole time.").otherwise("- The level must not drift."),
        F.when(c("seasonality") == "weekly", "- The same days of the week must be alike in all weeks.").otherwise("- There must be no rhythm of seven days."),
        F.when(c("anomalies") == "point", F.format_string("- Exactly %d single values must reach %.0f or more, all others must stay below.", "expected_anomalies", "anomaly_threshold")).otherwise("- No single value may stand out."),
    )


def values_text(values: Column, decimals: int = 2) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: F.format_string(f"%.{decimals}f", v)), ", "), F.lit("]"))


def canonical_text() -> Column:
    return F.concat(F.lit("A made-up example of such a pattern:\n"), _by(pattern(), {k: "[" + ", ".join(map(str, v)) + "]" for k, v in CANONICAL.items()}))


def attributes() -> Column:
    """Trend, periodicity, local fluctuation and noise as structs of type and description (and period or expected_count)."""
    c = F.col
    rising, falling, weekly, point = c("trend") == "increasing", c("trend") == "decreasing", c("seasonality") == "weekly", c("anomalies") == "point"
    text = lambda *pairs: _chain(pairs)
    return F.struct(
        F.struct(text((rising, "increasing"), (falling, "decreasing"), (None, "stable")).alias("type"), text((rising, "values rise over the whole time"), (falling, "values fall over the whole time"), (None, "values keep their level")).alias("description")).alias("trend_attribute"),
        F.struct(text((weekly, "weekly"), (None, "none")).alias("type"), F.when(weekly, F.coalesce("seasonality_period", F.lit(7))).alias("period"), text((weekly, "a shape of seven days comes again"), (None, "no shape comes again")).alias("description")).alias("periodicity_attribute"),
        F.struct(text((point, "point_spikes"), (None, "none")).alias("type"), F.when(point, c("expected_anomalies")).otherwise(0).alias("expected_count"), text((point, "a few single values stand out"), (None, "no single value stands out")).alias("description")).alias("local_fluctuation_attribute"),
        F.struct(c("noise").alias("type"), text((c("noise") == "low", "noise is small and hides nothing"), (None, "noise is as strong as the profile says")).alias("description")).alias("noise_attribute"),
    )


def _chain(pairs) -> Column:
    out = None
    for test, text in pairs:
        out = F.lit(text) if out is None and test is None else out.otherwise(text) if test is None else F.when(test, text) if out is None else out.when(test, text)
    return out


def guidance_text() -> Column:
    """The attributes as lines to follow."""
    a = attributes()
    line = lambda name, k: F.concat(F.lit(f"- {name} ("), a[k]["type"], F.lit("): "), a[k]["description"])
    count = F.when(a["local_fluctuation_attribute"]["expected_count"] > 0, F.format_string("- Exactly %d values reach %.0f or more.", "expected_anomalies", "anomaly_threshold"))
    return F.concat_ws("\n", line("Trend", "trend_attribute"), line("Periodicity", "periodicity_attribute"), line("Local fluctuation", "local_fluctuation_attribute"), line("Noise", "noise_attribute"), count)


def scale_text() -> Column:
    """Length in weeks, normal range and pattern, for answers of values only."""
    n = F.col("length").cast("int")
    weeks = F.format_string("That is %d whole weeks and %d more days.", F.floor(n / 7), n % 7)
    normal = F.format_string("Usual values lie between %.0f and %.0f.", "normal_min", "normal_max")
    kinds = {
        "rising_weekly_spikes": "Repeat one shape of seven days, a little higher each week, and add the spikes to single days.", "spikes": "Stay within the usual values but for the spikes.",
        "rising_weekly": "Repeat one shape of seven days, a little higher each week.", "weekly": "Repeat one shape of seven days at the same level.", "rising": "Rise evenly from the first to the last value.",
        "falling": "Fall evenly from the first to the last value.", "level": "Stay close to one level.",
    }
    noise = F.when(F.col("noise") == "low", "Change little around this pattern.").when(F.col("noise") == "high", "Change strongly around this pattern, without hiding it.").otherwise("Change moderately around this pattern.")
    return F.concat_ws("\n", weeks, normal, _by(pattern(), kinds), noise)


def example_text(number: Column, reference_id: Column, values: Column, mean: Column, std: Column, slope: Column, role: Column | None = None) -> Column:
    """A reference example: its name, its main features and its values."""
    head = F.format_string("Example %d (%s)", number, reference_id)
    return F.concat_ws("\n", head, role, F.format_string("mean %.2f, deviation %.2f, slope %.3f", mean, std, slope), values_text(values)) if role is not None else F.concat_ws("\n", head, F.format_string("mean %.2f, deviation %.2f, slope %.3f", mean, std, slope), values_text(values))


def feedback_text(failed: Column, slope: Column | None = None, weekly: Column | None = None, anomalies: Column | None = None) -> Column:
    """One line for each failed check, in their order, then what was measured."""
    lines = F.transform(failed, lambda c: F.concat(F.lit("- "), F.coalesce(_by(c, CHECK_TEXTS), c)))
    more = [F.format_string(t, x) for t, x in (("- slope of the answer: %.4f", slope), ("- correlation with the week before: %.4f", weekly), ("- values that stand out: %d", anomalies)) if x is not None]
    shown = [F.when(x.isNotNull(), m) for m, x in zip(more, [x for x in (slope, weekly, anomalies) if x is not None], strict=True)]
    return F.when(F.size(failed) == 0, "All checks passed.").otherwise(F.concat_ws("\n", F.array_join(lines, "\n"), *shown))


def variation_text(candidate: Column) -> Column:
    kind = F.regexp_replace(pattern(), "^.*spikes$", "spikes")
    texts = F.element_at(F.create_map(*[x for k, v in VARIATIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), kind)
    return F.coalesce(F.get(texts, (candidate - 1).cast("int")), F.lit(OTHER_VARIATION))


OBJECTS = 'Answer with a JSON list of objects with "timestamp" and "value" and nothing else.'
NUMBERS = "Answer with a JSON list of numbers and nothing else."


def build_prompts(runs: DataFrame) -> DataFrame:
    """Adds ``prompt`` to planned runs (``method``, profile columns, and where the method shows them ``examples``)."""
    examples = F.when(F.size("examples") > 0, F.concat(F.lit("Examples of the same profile:\n"), F.array_join("examples", "\n\n"))) if "examples" in runs.columns else F.lit(None)
    shown = lambda lead: F.concat_ws("\n", F.lit(lead), examples)
    body = {
        "prompt_only": pattern_text(), "constraint_guided": rules_text(), "canonical_few_shot": F.concat_ws("\n", pattern_text(), canonical_text()),
        "random_few_shot": F.concat_ws("\n", pattern_text(), shown("These examples were drawn at random; do not repeat them.")),
        "harmonic_knn": F.concat_ws("\n", pattern_text(), shown("These examples lie close to one another; write one more of their kind.")),
        "tabgen_icl_residual": F.concat_ws("\n", pattern_text(), shown("These examples show what earlier answers lack; make up for it.")),
        "chatts_attribute_prompting": guidance_text(), "epic_grouped_attribute_few_shot": F.concat_ws("\n", guidance_text(), shown("Each example shows one of these sides.")),
        "validator_feedback_refinement": F.concat_ws("\n", rules_text(), F.lit("The answer will be checked against these rules.")),
        "cllm_generate_curate": F.concat_ws("\n", rules_text(), F.lit("Several answers are asked for and the best is kept.")), "value_only_controlled_scale": F.concat_ws("\n", rules_text(), scale_text()),
    }
    chosen = None
    for method, text in body.items():
        chosen = F.when(F.col("method") == method, text) if chosen is None else chosen.when(F.col("method") == method, text)
    return runs.withColumn("prompt", F.concat_ws("\n", task_text(), chosen, F.when(F.col("value_only"), NUMBERS).otherwise(OBJECTS)))


def refinement_prompt(values: Column, feedback: Column) -> Column:
    """The second prompt of a refinement: rules, the last values and what was wrong with them."""
    return F.concat_ws("\n", task_text(), rules_text(), F.lit("Your last answer was:"), values_text(values), F.lit("It was not right:"), feedback, F.lit(NUMBERS))


def candidate_prompt(candidate: Column, n: Column) -> Column:
    """The prompt of one of n candidates."""
    return F.concat_ws("\n", task_text(), rules_text(), F.format_string("This is answer %d of %d.", candidate.cast("int"), n.cast("int")), variation_text(candidate), F.lit(NUMBERS))
