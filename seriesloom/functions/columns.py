"""Scalar and aggregate column expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$"


def clean(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def to_number(text: Column) -> Column:
    """A finite double from text as a tolerant reader takes it, else NULL ('1_0' is 10, '12d' is none)."""
    bare = F.replace(F.trim(text), F.lit("_"), F.lit(""))
    return clean(F.when(text.rlike(NUMBER), bare.try_cast("double")))


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(clean(x), F.lit(0.0))))


def clip(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))


def safe_corr(x: Column, y: Column, over=None) -> Column:
    """Pearson correlation of complete pairs; 0 where a side is constant."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    parts = [F.covar_pop(a, b), F.stddev_pop(a), F.stddev_pop(b)]
    cov, sa, sb = [p.over(over) for p in parts] if over is not None else parts
    return F.coalesce(F.try_divide(cov, sa * sb), F.lit(0.0))


def slug(text: Column) -> Column:
    out = F.regexp_replace(F.trim(text), r"[^A-Za-z0-9._-]+", "_")
    out = F.regexp_replace(F.regexp_replace(out, r"_+", "_"), r"^_|_$", "")
    return F.coalesce(F.when(out != "", out), F.lit("unknown"))


def experiment_id(profile: Column, method: Column, model: Column, batch: Column, run: Column) -> Column:
    return F.concat_ws("_", profile, method, slug(model), batch, F.concat(F.lit("run"), run.cast("string")))


def run_number(text: Column) -> Column:
    first = lambda p: F.when(text.rlike(p), F.regexp_extract(text, p, 1)).try_cast("int")
    return F.coalesce(first(r"_run(\d+)$"), first(r"run(\d+)"))


def numbers(text: Column) -> Column:
    """All decimal numbers in a text, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double"))


def as_flag(x: Column) -> Column:
    """NULL is false; texts true, 1, yes and y are true."""
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin("true", "1", "yes", "y"), F.lit(False))


def joined_list(x: Column) -> Column:
    """Items of an array with '|' between; NULL if there are none."""
    out = F.array_join(F.transform(x, lambda v: v.cast("string")), "|")
    return F.when(F.size(x) > 0, out)


def uniform(*keys, seed: int | Column = 42) -> Column:
    """A number in [0, 1) that depends on the keys and the seed only, not on partitioning: 52 bits of an MD5."""
    text = F.concat_ws("|", *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys], (F.lit(seed) if isinstance(seed, int) else seed).cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long").cast("double") / float(1 << 52)


def normal(*keys, seed: int | Column = 42) -> Column:
    """Standard normal by Box and Muller from two such numbers."""
    u, v = uniform(*keys, F.lit("u"), seed=seed), uniform(*keys, F.lit("v"), seed=seed)
    return F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(2.0 * 3.141592653589793 * v)
