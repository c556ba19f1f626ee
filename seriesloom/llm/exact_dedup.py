"""Exact deduplication with a heavy-hitter split (DataFrame functions only).

A Misra-Gries pass (``freqItems``, one bounded map of ``1 / support`` counters
per task, merged) proposes the digests that more than ``support`` of all rows
share. It has no false negatives, so every digest outside the verified winners
belongs to less than ``support`` of the rows. Winners (at most ``1 / support``
of them, whatever the input) are counted exactly and broadcast, so rows of hot
groups are decided where they are read and never meet in one task. All other
digests are shuffled in the ordinary way. Texts themselves are never shuffled:
they are read once, and only (doc_id, row number, digest) goes on. The row that
stays is the largest (id, row number), so equal rows of one id need no window.

Defined results: a null text counts as empty; texts of any length are digested
whole; equal rows (same id and text) keep exactly one of them; a null id loses to
any other id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import fresh, sortable, staged, text_or_empty

#: Share of all rows from which a digest is treated as a heavy hitter.
SUPPORT = 0.001


def exact_dedup(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256; a row for each input row."""
    digests = staged(docs.select(F.col("doc_id"), F.monotonically_increasing_id().alias("row"), F.sha2(text_or_empty(), 256).alias("text_sha256")), "exact-digests")
    rows = digests.count()
    winners = staged(_winners(digests, rows, support), "exact-winners")
    stays = F.col("stays.row") == F.col("row")
    columns = ["doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size", stays.alias("kept"), "text_sha256"]
    hot = digests.join(F.broadcast(winners), "text_sha256")
    group = Window.partitionBy("text_sha256")
    cold = digests.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    cold = cold.withColumn("stays", F.max(F.struct("doc_id", "row")).over(group)).withColumn("group_size", F.count(F.lit(1)).over(group))
    return hot.select(columns).unionByName(cold.select(columns))


def _winners(digests: DataFrame, rows: int, support: float) -> DataFrame:
    """Exact size and kept row of every digest with at least ``support * rows`` rows."""
    found = digests.stat.freqItems(["text_sha256"], support)
    found = found.select(F.explode(F.col(found.columns[0])).alias("text_sha256"))
    return (
        digests.join(F.broadcast(found), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(F.max(F.struct("doc_id", "row")).alias("stays"), F.count(F.lit(1)).alias("group_size"))
        .filter(F.col("group_size") >= F.lit(max(2.0, support * rows)))
    )


def drop_exact_copies(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The input's rows and columns without those whose text another kept row has.

    Of rows that share id and text the first by the other columns stays.
    """
    key, own, n = fresh(docs, "kept_key", "own_key", "copy")
    name = lambda digest: F.concat(digest, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    judged = staged(exact_dedup(docs.select("doc_id", "text"), support).select(name(F.col("text_sha256")).alias(key), "kept"), "exact-judged")
    kept = judged.filter("kept").select(key)
    rows = docs.withColumn(own, name(F.sha2(text_or_empty(), 256))).join(kept, F.col(own) == F.col(key), "left_semi")
    if judged.groupBy(key).agg(F.count(F.lit(1)).alias(n)).filter(F.col(n) > 1).limit(1).count():  # some rows share both
        one = F.row_number().over(Window.partitionBy(own).orderBy(*sortable(docs.drop("text"))))
        rows = rows.withColumn(n, one).filter(F.col(n) == 1)
    return rows.select(docs.columns)


EXACT_DEDUP_SQL = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY h ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       h AS text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)
WINDOW g AS (PARTITION BY h)
"""
