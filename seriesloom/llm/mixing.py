"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a fixed pseudo-random order, passed
through as often as ``max_repeat`` allows. A copy's virtual finish time is the
words its source has sent up to and with it, divided by the source's target.
All copies are sorted by that time over the whole corpus and the mix is the
prefix that fits the total budget.

Running sums are taken in two steps: the words of each (source, slice of the
hash range) are summed first, the prefix over those sums is small, and rows are
only ordered inside their slice. Both the slices and the rows of a slice grow
with the root of the rows, so neither a hot source nor the global order ever
meets in one task. The same holds for the global cut: virtual time is sliced, and
time slices carry near equal word counts because every source sends in
proportion to its target. Equal rows (id, source, text) are one entry with a
number, so they never meet in a slice either.

Defined results: a null or empty text has size 0 and is never taken (it would
add no words); texts of any length count whole; a null source is a source of its
own, last in order; rows with a null or a repeated id are documents of their own;
equal rows are taken one after the other; ties in time go by source, hash and
id; an empty table gives an empty result; further columns are ignored (and
passed on by ``mixed_documents``). The order depends on ids and texts only, so
reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import fresh, sortable, staged, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEAT = 2


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """source, source_rank, source_size, target from (source, size) rows.

    Targets are weight times one common level, except that none exceeds
    ``max_repeat`` times its source; what those leave goes to the others by
    weight. Sorted by the level at which a source is full, the common level is
    found in one pass over the sources (a row each).
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    picked = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("source_rank") - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("source_rank", F.row_number().over(by_name)).withColumn("weight", picked).withColumn("full", F.col("source_size") * float(max_repeat))
    order = Window.orderBy(F.col("full") / F.col("weight"), "source_rank")
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("full").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", level)
    found = F.min(F.when(F.col("level") <= F.col("full") / F.col("weight"), F.struct((F.col("full") / F.col("weight")).alias("f"), F.col("source_rank").alias("r"), F.col("level").alias("level")))).over(everything)["level"]
    target = F.when(found.isNull() | (F.col("full") / F.col("weight") < found), F.col("full")).otherwise(F.col("weight") * found)
    return per.select("source", "source_rank", "source_size", target.alias("target"))


def _hash() -> Column:
    """Place of a row in its source's queue: by id and text, so that rows without an id are spread too."""
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), text).cast("binary"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT, slices: int | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of each row; h and nth tell rows apart."""
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count().alias("size"), _hash().alias("h"))
    # equal rows stand next to each other in the queue: one entry with their number
    entries = staged(rows.groupBy("source", "h", "doc_id", "size").agg(F.count(F.lit(1)).alias("m")), "mix-entries")
    targets = staged(source_targets(entries.withColumn("size", F.col("size") * F.col("m")), weights, share, max_repeat), "mix-targets")
    # rows of a slice and slices of a source both grow with the root of the rows only
    slices = slices or max(1, math.isqrt(entries.count()))
    # the hash's first 8 hexadecimal digits, in order, cut into equal slices
    cut = F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * F.lit(slices) / F.lit(1 << 32)).cast("int")
    at = entries.withColumn("slice", cut)
    words = F.col("size") * F.col("m")
    sums = at.groupBy("source", "slice").agg(F.sum(words).alias("words"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).select(F.col("source").alias("s"), F.col("slice").alias("k"), "before")
    inside = Window.partitionBy("source", "slice").orderBy("h", "doc_id", "size")
    at = at.withColumn("place", F.row_number().over(inside)).withColumn("own", F.coalesce(F.sum(words).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = at.join(sums, at["source"].eqNullSafe(F.col("s")) & (F.col("slice") == F.col("k"))).drop("s", "k")
    t = targets.select(F.col("source").alias("s"), "source_rank", "source_size", "target")
    at = at.join(t, at["source"].eqNullSafe(F.col("s"))).drop("s").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    at = staged(at.withColumn("sent", F.col("before") + F.col("own") + F.col("nth") * F.col("size")), "mix-queue")
    empty = at.filter("size = 0").select(*_ROW, F.lit(0).alias("copies"), F.lit(0).cast("long").alias("taken"))
    copies = at.filter("size > 0").withColumn("pass", F.explode(F.array(*[F.lit(i) for i in range(max_repeat)])))
    finish = (F.col("sent") + F.col("pass") * F.col("source_size")) / F.col("target")
    return _cut(copies.withColumn("finish", finish), targets, slices).unionByName(empty)


_ROW = ["doc_id", "source", "h", "nth", "size", "source_size", "target"]


def _cut(copies: DataFrame, targets: DataFrame, slices: int) -> DataFrame:
    """Sort by finish time, slice by slice, and keep what fits the budget."""
    row = ["source_rank", "slice", "place", "nth"]
    sliced = copies.withColumn("at", F.floor(F.col("finish") * F.lit(slices)).cast("long"))
    sums = sliced.groupBy("at").agg(F.sum("size").alias("words"))
    before = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("at", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    order = Window.partitionBy("at").orderBy("finish", "source_rank", "h", "doc_id", "nth", "pass").rowsBetween(Window.unboundedPreceding, 0)
    budget = targets.agg(F.sum("target").alias("budget"))
    taken = sliced.withColumn("sum", F.sum("size").over(order)).join(sums, "at").crossJoin(F.broadcast(budget))
    # the sum of the targets is the budget up to rounding in the last bits
    fits = F.col("offset") + F.col("sum") <= F.col("budget") + 1e-6
    return taken.groupBy(*row).agg(
        *[F.first(c).alias(c) for c in _ROW if c != "nth"],
        F.sum(fits.cast("int")).cast("int").alias("copies"), F.sum(F.when(fits, F.col("size")).otherwise(0)).alias("taken"),
    ).select(*_ROW, "copies", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the input's rows and columns, each as often as taken; copies of a row follow each other.

    Rows of one id, source and text share their copies by number, in the order
    of their other columns.
    """
    key, nth, n, other, other_n = fresh(docs, "mix_key", "mix_nth", "mix_copies", "mix_other", "mix_other_nth")
    name = lambda h: F.md5(F.concat(h, F.coalesce(F.concat(F.lit("."), F.col("source").cast("string")), F.lit(""))).cast("binary"))
    picked = staged(mix_sources(docs, **options).filter("copies > 0").select(name(F.col("h")).alias(other), F.col("nth").alias(other_n), F.col("copies").alias(n)), "mix-picked")
    rows = docs.withColumn(key, name(_hash()))
    if docs.select(name(_hash()).alias(key)).groupBy(key).count().filter("count > 1").limit(1).count():
        rows = rows.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(*sortable(docs.drop("text")))))
    else:
        rows = rows.withColumn(nth, F.lit(1))
    rows = rows.join(picked, (F.col(key) == F.col(other)) & (F.col(nth) == F.col(other_n)))
    return rows.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(docs.columns)


MIX_SQL = r"""
WITH z AS (SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size,
             md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || md5(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM z GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM p),
v AS (SELECT *, CAST([3, 1, 2][((r - 1) % 3 + 1)::INT] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS full_at FROM w),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(full_at) OVER (ORDER BY full_at / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY full_at / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM v),
f AS (SELECT level AS found FROM l WHERE level <= full_at / weight ORDER BY full_at / weight, r LIMIT 1),
t AS (SELECT source, r, source_size, CASE WHEN f.found IS NULL OR full_at / weight < f.found THEN full_at ELSE weight * f.found END AS target
      FROM l LEFT JOIN f ON true),
c AS (SELECT z.doc_id, z.size, z.h, t.source_size, t.target, t.r, k.n,
             CASE WHEN t.target > 0 THEN (sum(z.size) OVER (PARTITION BY t.r, k.n ORDER BY z.h, z.doc_id ROWS UNBOUNDED PRECEDING) + k.n * t.source_size) / t.target ELSE 0 END AS finish
      FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source CROSS JOIN (SELECT unnest([0, 1]) AS n) k),
g AS (SELECT *, sum(size) OVER (ORDER BY finish, r, h, doc_id, n ROWS UNBOUNDED PRECEDING) AS upto FROM c)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
       CAST(sum(CASE WHEN upto <= (SELECT sum(target) FROM t) + 1e-6 THEN size ELSE 0 END) AS BIGINT) AS taken
FROM g GROUP BY doc_id
"""
