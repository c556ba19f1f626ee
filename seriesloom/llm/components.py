"""Connected components of a distributed list of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import distinct, staged


#: Links that one task solves; pointers that are broadcast, and copies of each where there are more.
MOST_LINKS, MOST_POINTERS, COPIES = 200_000, 50_000, 16


def _followed(near: DataFrame) -> DataFrame:
    """node, label: each node's pointer followed one step further.

    All nodes of a large component may point to one node. So the pointers of the
    nodes that are pointed to, one row each, go to the others: broadcast where
    their checked number is small, else in COPIES, so that no node's followers
    meet in one task.
    """
    lows = near.select(F.col("low").alias("k")).distinct()
    up = staged(lows.join(near, F.col("k") == F.col("a")).select("k", F.col("low").alias("further")), "cc-pointers")
    if up.count() <= MOST_POINTERS:
        joined = near.join(F.broadcast(up), F.col("low") == F.col("k"))
    else:
        salted = near.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(COPIES)).cast("int"))
        copies = up.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
        joined = salted.join(copies, (F.col("low") == F.col("k")) & (F.col("salt") == F.col("copy")))
    return joined.select(F.col("a").alias("node"), F.least("low", "further").alias("label"))


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, label of a graph that fits in one task."""
    parts = [(x["a"].to_numpy(), x["b"].to_numpy()) for x in batches]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    nodes = distinct(np.concatenate([a, b]))
    a, b = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    label = np.arange(len(nodes))
    while True:
        new, one, two = label.copy(), label[a], label[b]
        low = np.minimum(one, two)
        np.minimum.at(new, one, low)
        np.minimum.at(new, two, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "label"])


def components(links: DataFrame) -> DataFrame:
    """node, label (smallest node reachable) for (a, b) rows; both columns long.

    Each round every node of the remaining graph points to the smallest of its
    neighbours and itself, pointers are followed one step further, and links
    are drawn between the labels; those inside a label vanish, so the graph
    shrinks fast. Once its links are counted as MOST_LINKS or fewer, one task
    solves the rest. Every round is written to the shared folder. In the end the
    rounds are applied one after the other.
    """
    edges = staged(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "cc-edges")
    rounds = []
    while n := edges.count():
        if n <= MOST_LINKS:
            rounds.append(staged(edges.coalesce(1).mapInArrow(_solved, "node long, label long"), "cc-labels"))
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low")), "cc-near")
        labels = staged(_followed(near), "cc-labels")
        rounds.append(labels)
        one = edges.join(labels.withColumnRenamed("node", "a"), "a").select(F.col("label").alias("x"), "b")
        two = one.join(labels.withColumnRenamed("node", "b"), "b").select("x", F.col("label").alias("y"))
        edges = staged(two.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    if len(rounds) == 1:
        return rounds[0]
    found = rounds[0]
    for later in rounds[1:]:
        then = later.select(F.col("node").alias("k"), F.col("label").alias("final"))
        found = found.join(then, found["label"] == then["k"], "left").select("node", F.coalesce("final", "label").alias("label"))
    return staged(found, "cc-found")
