"""Choosing reference examples: sampling, neighbours, distributions, roles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.columns import uniform


def seeded_sample(rows: DataFrame, n: int, seed: int, id_col: str = "reference_id") -> DataFrame:
    """n rows in the order of a hash of id and seed: the same on any partitioning."""
    return rows.orderBy(uniform(id_col, seed=seed), id_col).limit(n)


#: Values that one task sorts, and slices that more are cut into.
MOST_SORTED, SLICES = 1_000_000, 64


def exact_quantiles(rows: DataFrame, column: str, shares: list[float], most: int = MOST_SORTED) -> list[float | None]:
    """Linearly interpolated quantiles of all values that are not NULL or NaN.

    While more than ``most`` values are in question, a mergeable sketch cuts them
    into SLICES, one pass counts the slices, and only those that hold a wanted
    rank are looked at further; so no task ever holds all distinct values. Only
    small results come to the driver.
    """
    return all_quantiles(rows, [column], shares, most)[column]


def all_quantiles(rows: DataFrame, columns: list[str], shares: list[float], most: int = MOST_SORTED) -> dict[str, list[float | None]]:
    """``exact_quantiles`` of several columns; those of at most ``most`` values are read in one pass."""
    known = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    counts = rows.agg(*[F.count(x).alias(c) for c, x in known.items()]).first()
    out: dict[str, list[float | None]] = {c: [None] * len(shares) for c in columns}
    small = [c for c in columns if 0 < counts[c] <= most]
    if small:
        read = rows.agg(*[F.percentile(known[c], F.array(*map(F.lit, shares))).alias(c) for c in small]).first()
        out |= {c: list(read[c]) for c in small}
    for c in columns:
        if (n := counts[c]) > most:
            found = _at_ranks(rows.select(known[c].alias("x")).filter("x is not null"), n, {r for s in shares for r in (math.floor((n - 1) * s), math.ceil((n - 1) * s))}, most)
            out[c] = [found[low] + (found[math.ceil(at)] - found[low]) * (at - low) for at in ((n - 1) * s for s in shares) for low in (math.floor(at),)]
    return out


def _at_ranks(values: DataFrame, n: int, ranks: set[int], most: int) -> dict[int, float]:
    """The values that stand at some ranks (from 0) of all n."""
    if n <= most:
        rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("x")) - 1
        return {r["r"]: r["x"] for r in values.withColumn("r", rank).filter(F.col("r").isin(list(ranks))).collect()}
    cuts = sorted(set(values.agg(F.percentile_approx("x", [i / SLICES for i in range(1, SLICES)], 10 * SLICES).alias("c")).first()["c"]))
    # a value that is a cut is a slice of its own, so frequent values are settled at once
    placed = values.withColumn("k", 2 * _below(F.col("x"), cuts) + F.col("x").isin(cuts).cast("int"))
    found, upto = {}, 0
    for s in sorted(placed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()):
        inside = {r - upto for r in ranks if upto <= r < upto + s["n"]}
        if inside:
            part = dict.fromkeys(inside, s["low"]) if s["low"] == s["high"] else _at_ranks(placed.filter(F.col("k") == s["k"]).select("x"), s["n"], inside, most)
            found |= {r + upto: x for r, x in part.items()}
        upto += s["n"]
    return found


def _below(x: Column, cuts: list[float]) -> Column:
    """How many cuts lie below x, by halving."""
    if not cuts:
        return F.lit(0)
    m = len(cuts) // 2
    return F.when(x > cuts[m], m + 1 + _below(x, cuts[m + 1 :])).otherwise(_below(x, cuts[:m]))


def standardised(features: DataFrame, names: list[str]) -> DataFrame:
    """Nulls become the median, then (x - median) / population deviation of the filled column (0 counts as 1).

    A column without any value stays NULL and counts in no distance.
    """
    medians = {c: x[0] for c, x in all_quantiles(features, names, [0.5]).items()}
    filled = features.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) for c in names})
    stats = filled.agg(*[F.stddev_pop(c).alias(f"{c}_s") for c in names])
    z = lambda c: (F.col(c) - F.lit(medians[c])) / F.coalesce(F.nullif(F.col(f"{c}_s"), F.lit(0.0)), F.lit(1.0))
    return filled.crossJoin(F.broadcast(stats)).withColumns({f"z_{c}": z(c) for c in names}).drop(*[f"{c}_s" for c in names])  # one row


def nearest(features: DataFrame, names: list[str], anchor_id, n: int, id_col: str = "reference_id") -> DataFrame:
    """The n rows closest to the anchor (itself left out); ties by id."""
    z = standardised(features, names)
    anchor = z.filter(F.col(id_col) == anchor_id).select(*[F.col(f"z_{c}").alias(f"a_{c}") for c in names]).limit(1)
    square = sum((F.coalesce(F.pow(F.col(f"z_{c}") - F.col(f"a_{c}"), 2), F.lit(0.0)) for c in names), F.lit(0.0))
    return z.crossJoin(F.broadcast(anchor)).filter(F.col(id_col) != anchor_id).select(id_col, F.sqrt(square).alias("distance")).orderBy("distance", id_col).limit(n)


def js_distance(reference: DataFrame, candidates: DataFrame, column: str, group: list[str], n_bins: int = 10, smoothing: float = 1.0) -> DataFrame:
    """Square root of the Jensen-Shannon divergence (natural log) of each group of candidates to the reference.

    Equal-width bins over the reference's range, as many as it has distinct
    values within 2 to n_bins, the last one closed; values outside are left
    out; a constant reference gives 0 if all candidate values equal it, else 1.
    Each side is counted in one pass; what is left has n_bins rows a group.
    """
    ref = reference.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"), F.least(F.lit(n_bins), F.greatest(F.lit(2), F.count_distinct(column))).cast("int").alias("k")).first()
    lo, hi, k = ref["lo"], ref["hi"], ref["k"]
    if lo is None or lo == hi:
        equal = F.coalesce(F.bool_and(F.col(column) == lo), F.lit(False)) if lo is not None else F.lit(False)
        return candidates.groupBy(*group).agg(F.when(equal, 0.0).otherwise(1.0).alias("distance"))
    slot = F.least(F.lit(k - 1), F.floor((F.col(column) - lo) / (hi - lo) * k)).cast("int")
    inside = F.col(column).between(lo, hi)
    count = lambda b: F.count_if(inside & (slot == b)) + smoothing
    p = reference.agg(*[count(b).alias(f"p{b}") for b in range(k)]).first()
    total = sum(p)
    each = candidates.groupBy(*group).agg(F.count(column).alias("known"), *[count(b).alias(f"q{b}") for b in range(k)])
    all_of = sum((F.col(f"q{b}") for b in range(1, k)), F.col("q0"))
    parts = []
    for b in range(k):
        x, y = F.lit(p[b] / total), F.col(f"q{b}") / all_of
        m = (x + y) / 2
        parts.append((x * F.log(x / m) + y * F.log(y / m)) / 2)
    d = F.sqrt(F.greatest(F.lit(0.0), sum(parts[1:], parts[0])))
    return each.select(*group, F.when(F.col("known") == 0, 1.0).otherwise(d).alias("distance"))


def quantile_bins(features: DataFrame, column: str, q: int = 5) -> DataFrame:
    """Rows with ``bin``: right-closed bins between linearly interpolated quantiles, the lowest value included."""
    cuts = sorted({x for x in exact_quantiles(features, column, [i / q for i in range(q + 1)]) if x is not None})
    below = F.size(F.filter(F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>"), lambda c: c < F.col(column)))
    return features.filter(F.col(column).isNotNull()).withColumn("bin", F.greatest(F.lit(0), below - 1))


def closest_subset(reference: DataFrame, members: DataFrame, columns: list[str]) -> DataFrame:
    """The candidate (column ``candidate``) whose members' mean distance to the reference is least; first wins."""
    parts = None
    for c in columns:
        d = js_distance(reference, members, c, ["candidate"]).withColumnRenamed("distance", f"d_{c}")
        parts = d if parts is None else parts.join(d, "candidate")
    scored = parts.select("candidate", (sum((F.col(f"d_{c}") for c in columns), F.lit(0.0)) / len(columns)).alias("distance"))
    return scored.orderBy("distance", "candidate").limit(1)  # of no usable column there is no distance, so none is chosen


def by_roles(features: DataFrame, roles: list[tuple[str, str]], id_col: str = "reference_id") -> DataFrame:
    """role, id: for each role in turn the best row (smallest of a SQL score, nulls last, ties by id) not chosen yet."""
    chosen = None
    for role, score in roles:
        left = features if chosen is None else features.join(F.broadcast(chosen.select(id_col)), id_col, "left_anti")
        best = left.select(id_col, F.expr(score).alias("s")).orderBy(F.col("s").asc_nulls_last(), id_col).limit(1).select(F.lit(role).alias("role"), id_col)
        chosen = best if chosen is None else chosen.unionByName(best)
    return chosen


def prefer_valid(rows: DataFrame, *group: str) -> DataFrame:
    """Only valid rows where a group has one, else all of the group."""
    any_valid = F.max(F.coalesce("valid", F.lit(False))).over(Window.partitionBy(*group))
    return rows.withColumn("any_valid", any_valid).filter(F.coalesce(F.col("valid"), F.lit(False)) == F.col("any_valid")).drop("any_valid")
