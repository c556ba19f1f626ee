"""Choice of reference examples for many planned runs at once.

A *request* is a planned run: experiment_id, profile_id, run_id, n_examples,
selection_seed, and for the residual choice model and batch_id. The reference
bank holds few series for each profile, so requests meet their profile's bank in
one join, and everything random is a hash of the request's seed plus run_id and
the reference's id, the same on any partitioning.

Each function returns experiment_id, position (from 1), reference_id and what it
knows of the choice; ``selection_info`` gathers it into one row a request.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.columns import uniform

# Features that references are compared by.
FEATURES = ("mean", "std", "trend_slope", "weekly_autocorrelation", "anomaly_count")
BINS, SUBSET_BINS, RANDOM_SUBSETS, MOST_SUBSETS, ROLE_TOP = 10, 5, 10, 30, 5
RESIDUAL_METHOD = "tabgen_icl_residual"
# The roles of grouped examples in their order.
ROLES = ("trend_attribute", "stable_trend_attribute", "periodicity_attribute", "local_fluctuation_attribute", "noise_attribute", "filler_reference")
ROLE_TEXTS = {
    "trend_attribute": "shows the rising trend that is asked for", "stable_trend_attribute": "shows a level baseline with little drift", "periodicity_attribute": "shows the weekly rhythm that is asked for",
    "local_fluctuation_attribute": "shows single spikes on a level baseline", "noise_attribute": "shows the small noise and the scale that are expected", "filler_reference": "gives further context for the profile",
}


def _seed() -> Column:
    return F.col("selection_seed") + F.col("run_id")


def _of_profile(requests: DataFrame, features: DataFrame) -> DataFrame:
    return requests.join(features.select("profile_id", "reference_id", *[c for c in FEATURES if c in features.columns]), "profile_id")


def random_examples(requests: DataFrame, features: DataFrame) -> DataFrame:
    """n_examples references of the profile, drawn by seed + run_id."""
    turn = F.row_number().over(Window.partitionBy("experiment_id").orderBy(uniform("reference_id", seed=_seed()), "reference_id"))
    return _of_profile(requests, features).withColumn("position", turn).filter(F.col("position") <= F.col("n_examples")).select("experiment_id", "position", "reference_id")


def usable_features(features: DataFrame, *by: str) -> DataFrame:
    """by, names: the FEATURES that have a value, in their order."""
    there = [c for c in FEATURES if c in features.columns]
    has = [F.when(F.bool_or(F.col(c).isNotNull()), F.lit(c)) for c in there]
    return features.groupBy(*by).agg(F.filter(F.array(*has), lambda x: x.isNotNull()).alias("names"))


def anchor_neighbours(requests: DataFrame, features: DataFrame) -> DataFrame:
    """The references nearest to one drawn by seed + run_id (itself left out), also anchor_reference_id and anchor_position.

    Features are filled with the profile's median and divided by the deviation
    of the filled column; those without any value are left out, and a profile
    without any usable feature is an error.
    """
    there = [c for c in FEATURES if c in features.columns]
    if not usable_features(features, "profile_id").filter(F.size("names") == 0).isEmpty():
        raise ValueError("a profile has no feature to compare references by")
    w = Window.partitionBy("profile_id")
    z = features.select("profile_id", "reference_id", *[F.col(c).cast("double").alias(c) for c in there])
    z = z.withColumns({f"m_{c}": F.median(c).over(w) for c in there})
    z = z.withColumns({c: F.coalesce(c, f"m_{c}") for c in there})
    z = z.withColumns({f"s_{c}": F.stddev_pop(c).over(w) for c in there})
    scaled = F.array(*[F.coalesce((F.col(c) - F.col(f"m_{c}")) / F.coalesce(F.nullif(F.col(f"s_{c}"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0)) for c in there])
    z = z.select("profile_id", "reference_id", scaled.alias("z"), (F.row_number().over(w.orderBy("reference_id")) - 1).alias("place"), F.count(F.lit(1)).over(w).alias("available"))
    anchors = requests.join(z.select("profile_id", F.col("reference_id").alias("anchor_reference_id"), F.col("place").alias("anchor_position"), F.col("z").alias("a"), "available"), "profile_id")
    anchors = anchors.filter(F.col("anchor_position") == F.floor(uniform(F.lit("anchor"), seed=_seed()) * F.col("available")).cast("int")).drop("available")
    near = anchors.join(z.select("profile_id", "reference_id", "z"), "profile_id").filter(F.col("reference_id") != F.col("anchor_reference_id"))
    near = near.withColumn("distance", F.sqrt(F.aggregate(F.zip_with("z", "a", lambda x, y: F.pow(x - y, F.lit(2.0))), F.lit(0.0), lambda x, y: x + y)))
    near = near.withColumn("position", F.row_number().over(Window.partitionBy("experiment_id").orderBy("distance", "reference_id")))
    return near.filter(F.col("position") <= F.col("n_examples")).select("experiment_id", "position", "reference_id", "distance", "anchor_reference_id", "anchor_position")


def generated_features(series_features: DataFrame, runs: DataFrame, method: str = RESIDUAL_METHOD) -> DataFrame:
    """Features of earlier runs' series that the residual choice may look at, by profile, model and batch.

    Successful runs of other methods with a series; where a group has valid
    series, only those. ``series_features``: series_id (the experiment_id) and
    FEATURES.
    """
    usable = runs.filter((F.col("status") == "success") & F.col("experiment_id").isNotNull() & (F.col("method") != method))
    rows = usable.select("experiment_id", "profile_id", "model", "batch_id", "valid_series").join(series_features.withColumnRenamed("series_id", "experiment_id"), "experiment_id")
    any_valid = F.max(F.coalesce("valid_series", F.lit(False))).over(Window.partitionBy("profile_id", "model", "batch_id"))
    return rows.withColumn("any_valid", any_valid).filter(F.coalesce("valid_series", F.lit(False)) == F.col("any_valid")).drop("any_valid", "valid_series")


def _long(df: DataFrame, *keep: str) -> DataFrame:
    there = [c for c in FEATURES if c in df.columns]
    rows = df.select(*keep, F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(c).cast("double").alias("x")) for i, c in enumerate(FEATURES) if c in there])).alias("f"))
    return rows.select(*keep, "f.feature", "f.x").filter(F.col("x").isNotNull())


def candidate_subsets(requests: DataFrame, features: DataFrame, most: int = MOST_SUBSETS) -> DataFrame:
    """experiment_id, candidate_id (from 0), reference_ids: subsets to choose from.

    For each usable feature (``names`` of the request) the quantile bins of the
    profile's references, right-closed, each thinned to n_examples by draw; then
    RANDOM_SUBSETS drawn from all. Of equal sets the first counts, and the first
    ``most`` are kept, as the choice is defined on them.
    """
    long = _long(features, "profile_id", "reference_id")
    per = long.groupBy("profile_id", "feature").agg(F.count(F.lit(1)).alias("m"), F.count_distinct("x").alias("u"), F.sort_array(F.collect_list("x")).alias("xs"))
    per = per.filter("m >= 2 and u >= 2").withColumn("q", F.least(F.lit(SUBSET_BINS), F.col("u")).cast("int"))
    at = lambda i: (F.col("m") - 1) * i / F.col("q")
    low, high = (lambda i: F.element_at("xs", F.floor(at(i)).cast("int") + 1)), (lambda i: F.element_at("xs", F.ceil(at(i)).cast("int") + 1))
    cuts = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("q")), lambda i: low(i) + (high(i) - low(i)) * (at(i) - F.floor(at(i)))))
    bins = long.join(per.select("profile_id", "feature", cuts.alias("cuts")), ["profile_id", "feature"])
    x = F.col("x")
    bins = bins.select("profile_id", "feature", "reference_id", F.greatest(F.lit(0), F.size(F.filter("cuts", lambda c: c < x)) - 1).alias("bin"))
    keys = requests.select("experiment_id", "profile_id", "n_examples", _seed().alias("seed"), "names")
    name = F.element_at(F.array(*map(F.lit, FEATURES)), F.col("feature") + 1)
    binned = keys.join(bins, "profile_id").filter(F.array_contains("names", name)).select("experiment_id", "n_examples", "seed", (F.col("feature") * 100 + F.col("bin")).alias("place"), "reference_id")
    drawn = keys.join(features.select("profile_id", "reference_id"), "profile_id").withColumn("place", F.explode(F.sequence(F.lit(10_000), F.lit(10_000 + RANDOM_SUBSETS - 1))))
    rows = binned.unionByName(drawn.select(binned.columns))
    turn = F.row_number().over(Window.partitionBy("experiment_id", "place").orderBy(uniform("reference_id", "place", seed=F.col("seed")), "reference_id"))
    sets = rows.withColumn("turn", turn).filter(F.col("turn") <= F.col("n_examples")).groupBy("experiment_id", "place").agg(F.sort_array(F.collect_list("reference_id")).alias("reference_ids"))
    first = sets.groupBy("experiment_id", "reference_ids").agg(F.min("place").alias("place"))
    numbered = first.withColumn("candidate_id", F.row_number().over(Window.partitionBy("experiment_id").orderBy("place")) - 1)
    return numbered.filter(F.col("candidate_id") < most).select("experiment_id", "candidate_id", "reference_ids")


def subset_distances(requests: DataFrame, features: DataFrame, generated: DataFrame, subsets: DataFrame) -> DataFrame:
    """experiment_id, candidate_id, reference_ids, distance to the bank of generated series and subset together.

    The mean over the request's features of the square root of the
    Jensen-Shannon divergence, on equal-width bins of the bank's values (as many
    as it has distinct values within 2 to BINS), each bin counting one more.
    Generated series are counted by bin once for each (profile, model, batch),
    so a request costs the same however many runs came before it.
    """
    group = ["profile_id", "model", "batch_id"]
    refs = _long(features, "profile_id", "reference_id")
    edges = refs.groupBy("profile_id", "feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.least(F.lit(BINS), F.greatest(F.lit(2), F.count_distinct("x"))).cast("int").alias("k"))
    slot = F.when(F.col("x").between(F.col("lo"), F.col("hi")), F.least(F.col("k") - 1, F.coalesce(F.floor((F.col("x") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * F.col("k")), F.lit(0)))).cast("int")
    counted = lambda df, *by: df.join(edges, ["profile_id", "feature"]).withColumn("bin", slot).groupBy(*by, "profile_id", "feature", "bin").agg(F.count(F.lit(1)).alias("c"))
    gen = counted(_long(generated, *group), "model", "batch_id")
    wanted = requests.select("experiment_id", *group, "names")
    name = F.element_at(F.array(*map(F.lit, FEATURES)), F.col("feature") + 1)
    same = [F.col(f"w.{g}").eqNullSafe(F.col(f"g.{g}")) for g in group]
    from_gen = wanted.alias("w").join(gen.alias("g"), reduce(lambda a, b: a & b, same)).select("w.experiment_id", "w.profile_id", "g.feature", "g.bin", "g.c")
    every = subsets.select("experiment_id", "candidate_id")
    from_gen = from_gen.join(every, "experiment_id").select("experiment_id", "candidate_id", "profile_id", "feature", "bin", "c")
    members = subsets.select("experiment_id", "candidate_id", F.explode("reference_ids").alias("reference_id")).join(wanted.select("experiment_id", "profile_id"), "experiment_id")
    from_set = members.join(refs, ["profile_id", "reference_id"]).join(edges, ["profile_id", "feature"]).withColumn("bin", slot)
    from_set = from_set.groupBy("experiment_id", "candidate_id", "profile_id", "feature", "bin").agg(F.count(F.lit(1)).alias("c"))
    cand = from_gen.unionByName(from_set).groupBy("experiment_id", "candidate_id", "profile_id", "feature", "bin").agg(F.sum("c").alias("c"))
    # a map of counts by bin; the bin NULL holds values outside the bank's range
    hist = lambda df, *by: df.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "c")))).alias("h"), F.coalesce(F.sum(F.when(F.col("bin").isNull(), F.col("c"))), F.lit(0)).alias("outside"), F.sum("c").alias("all"))
    ref_hist = hist(counted(refs), "profile_id", "feature").join(edges, ["profile_id", "feature"]).withColumnRenamed("h", "p").drop("outside", "all")
    rows = wanted.select("experiment_id", "profile_id", "names").join(every, "experiment_id").join(ref_hist, "profile_id").filter(F.array_contains("names", name))
    rows = rows.join(hist(cand, "experiment_id", "candidate_id", "profile_id", "feature"), ["experiment_id", "candidate_id", "profile_id", "feature"], "left")
    smoothed = lambda h: F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda b: F.coalesce(F.col(h)[b], F.lit(0)) + 1.0)
    rows = rows.withColumns({"ps": smoothed("p"), "hs": smoothed("h")})
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    rows = rows.withColumn("pt", total("ps")).withColumn("ht", total("hs"))

    def term(p: Column, q: Column) -> Column:
        p, q = p / F.col("pt"), q / F.col("ht")
        m = (p + q) / 2
        return (p * F.log(p / m) + q * F.log(q / m)) / 2

    d = F.sqrt(F.greatest(F.lit(0.0), total(F.zip_with("ps", "hs", term))))
    constant = F.col("lo") == F.col("hi")
    rows = rows.withColumn("d", F.when(F.col("all").isNull(), 1.0).when(constant, F.when(F.col("outside") == 0, 0.0).otherwise(1.0)).otherwise(d))
    scored = rows.groupBy("experiment_id", "candidate_id").agg(F.avg("d").alias("distance"))
    return subsets.join(scored, ["experiment_id", "candidate_id"], "left").withColumn("distance", F.coalesce("distance", F.lit(float("inf"))))


def residual_examples(requests: DataFrame, features: DataFrame, generated: DataFrame) -> DataFrame:
    """References that bring generated series and subset closest to the bank, and how they were chosen.

    Without generated series of the request's profile, model and batch, or
    without a feature that both have, references are drawn at random and
    ``fallback_reason`` says why. A subset of fewer than n_examples is topped up
    by draw.
    """
    group = ["profile_id", "model", "batch_id"]
    known = usable_features(features, "profile_id").withColumnRenamed("names", "bank")
    per = generated.groupBy(*group).agg(
        F.count(F.lit(1)).alias("generated_context_count"), F.sort_array(F.collect_list("experiment_id")).alias("generated_context_experiment_ids"),
        F.filter(F.array(*[F.when(F.bool_or(F.col(c).isNotNull()), F.lit(c)) for c in FEATURES if c in generated.columns]), lambda x: x.isNotNull()).alias("made"),
    )
    same = reduce(lambda a, b: a & b, [F.col(f"r.{g}").eqNullSafe(F.col(f"m.{g}")) for g in group])
    rows = requests.alias("r").join(per.alias("m"), same, "left").select("r.*", "m.generated_context_count", "m.generated_context_experiment_ids", "m.made").join(known, "profile_id", "left")
    rows = rows.withColumn("names", F.filter("bank", lambda x: F.array_contains("made", x)))
    reason = F.when(F.col("made").isNull(), "no_previous_generated_series").when(F.size("names") == 0, "no_common_feature_columns")
    rows = rows.withColumn("fallback_reason", reason).withColumn("generated_context_count", F.coalesce("generated_context_count", F.lit(0)))
    info = rows.select("experiment_id", "fallback_reason", "generated_context_count", "generated_context_experiment_ids", F.when(F.col("fallback_reason").isNull(), F.col("names")).alias("residual_feature_columns"))
    chosen = rows.filter("fallback_reason is null")
    scored = subset_distances(chosen, features, generated, candidate_subsets(chosen, features))
    # equal distances may differ in their last bits, as sums are taken in any order
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("experiment_id").orderBy(F.round("distance", 12), "candidate_id")))
    best = ranked.groupBy("experiment_id").agg(
        F.count(F.lit(1)).alias("n_candidate_subsets"), F.min("distance").alias("best_candidate_distance"), F.max(F.when(F.col("rank") == 1, F.col("reference_ids"))).alias("reference_ids"),
        F.sort_array(F.collect_list(F.when(F.col("rank") <= 5, F.struct("rank", "candidate_id", "distance", "reference_ids")))).alias("candidate_scores_summary"),
    )
    bank = rows.join(features.select("profile_id", "reference_id"), "profile_id").join(best, "experiment_id", "left")
    inside = F.coalesce(F.array_contains("reference_ids", F.col("reference_id")), F.lit(False))
    order = [F.when(inside, F.array_position("reference_ids", F.col("reference_id"))).otherwise(F.lit(1 << 30)), uniform("reference_id", seed=_seed()), "reference_id"]
    picked = bank.withColumn("position", F.row_number().over(Window.partitionBy("experiment_id").orderBy(*order))).filter(F.col("position") <= F.col("n_examples"))
    return picked.select("experiment_id", "position", "reference_id", F.col("best_candidate_distance").alias("distance"), "n_candidate_subsets", "candidate_scores_summary").join(info, "experiment_id")


def role_examples(requests: DataFrame, features: DataFrame) -> DataFrame:
    """References by role, in the order of ROLES, with role, description and score.

    Requests carry their profile's ``trend`` (increasing or not), ``seasonality``,
    ``anomalies`` and ``expected_anomalies``. For each role that the profile asks
    for, one of the ROLE_TOP best references not yet chosen is drawn; scores that
    are NULL are left out, unless all are, which then count as 0. Further
    references are drawn at random.
    """
    c = F.col
    rows = _of_profile(requests, features)
    slope = F.abs("trend_slope")
    rising, weekly, point = c("trend") == "increasing", c("seasonality") == "weekly", c("anomalies") == "point"
    steps = [
        # role, what is made least, whether the largest is meant, whether the profile asks for it
        (F.when(rising, "trend_attribute").otherwise("stable_trend_attribute"), F.when(rising, -c("trend_slope")).otherwise(slope), rising, F.lit(True)),
        (F.lit("periodicity_attribute"), -c("weekly_autocorrelation"), F.lit(True), weekly),
        (F.lit("local_fluctuation_attribute"), F.abs(c("anomaly_count") - c("expected_anomalies")) + slope, F.lit(False), point),
        (F.lit("noise_attribute"), c("std"), F.lit(False), F.lit(True)),
    ]
    w = Window.partitionBy("experiment_id")
    rows = rows.withColumns({"role": F.lit(None).cast("string"), "step": F.lit(None).cast("int"), "score": F.lit(None).cast("double")})
    for i, (role, value, largest, asked) in enumerate(steps):
        free = c("role").isNull() & F.coalesce(asked, F.lit(False))
        rows = rows.withColumn("value", F.when(free, value.cast("double")))
        rows = rows.withColumn("some", F.max(c("value").isNotNull()).over(w))
        rows = rows.withColumn("value", F.when(free, F.when(c("some"), c("value")).otherwise(0.0)))
        order = w.orderBy(c("value").asc_nulls_last(), "reference_id")
        rows = rows.withColumns({"rank": F.row_number().over(order), "of": F.least(F.lit(ROLE_TOP), F.count("value").over(w))})
        hit = c("value").isNotNull() & (c("rank") == F.floor(uniform(F.lit(f"role{i}"), seed=_seed()) * c("of")) + 1)
        shown = F.when(c("some"), F.when(largest, -value).otherwise(value)).otherwise(0.0)
        rows = rows.withColumns({"score": F.when(hit, shown).otherwise(c("score")), "step": F.when(hit, i).otherwise(c("step")), "role": F.when(hit, role).otherwise(c("role"))})
    turn = F.row_number().over(w.orderBy(c("step").asc_nulls_last(), uniform("reference_id", F.lit("filler"), seed=_seed()), "reference_id"))
    picked = rows.withColumn("position", turn).filter(c("position") <= c("n_examples")).withColumn("role", F.coalesce("role", F.lit("filler_reference")))
    text = F.element_at(F.create_map(*[F.lit(x) for kv in ROLE_TEXTS.items() for x in kv]), c("role"))
    return picked.select("experiment_id", "position", "reference_id", "role", text.alias("description"), "score")


def selection_info(requests: DataFrame, picked: DataFrame) -> DataFrame:
    """One row a request: n_examples_selected and selected_reference_ids in order, and what else ``picked`` has."""
    own = [x for x in ("distance", "role", "description") if x in picked.columns]
    lists = {"distance": "selected_reference_distances", "role": "selected_reference_roles", "description": "selected_reference_group_descriptions"}
    once = [x for x in picked.columns if x not in {"experiment_id", "position", "reference_id", "score", *own}]
    gathered = F.sort_array(F.collect_list(F.struct("position", "reference_id", *own)))
    per = picked.groupBy("experiment_id").agg(F.count(F.lit(1)).cast("int").alias("n_examples_selected"), gathered.alias("rows"), *[F.first(x).alias(x) for x in once])
    per = per.select("experiment_id", "n_examples_selected", F.col("rows.reference_id").alias("selected_reference_ids"), *[F.col(f"rows.{x}").alias(lists[x]) for x in own], *once)
    return requests.select("experiment_id", F.col("n_examples").alias("n_examples_requested"), _seed().alias("effective_seed")).join(per, "experiment_id", "left").withColumn("n_examples_selected", F.coalesce("n_examples_selected", F.lit(0)))
