"""Connected components of an edge table by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014). Each step moves
O(edges) rows through one shuffle and the number of rounds grows with the logarithm of the
component size. No link and no label ever reaches the driver: only a count and a checksum do.
A star centre of a large component collects one edge per member, so the window that finds each
node's smallest neighbour is replaced by a pre-aggregated minimum and a join that AQE can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (hi, lo) with hi > lo; returns distinct edges of the same shape."""
    if large:
        near = edges.select(F.col("hi").alias("node"), F.col("lo").alias("other")).unionAll(
            edges.select(F.col("lo").alias("node"), F.col("hi").alias("other"))
        )
    else:
        near = edges.select(F.col("hi").alias("node"), F.col("lo").alias("other"))
    least = near.groupBy("node").agg(F.min("other").alias("least"))
    least = least.select(F.col("node").alias("n"), F.least("least", "node").alias("root"))
    moved = near.join(least, near["node"] == least["n"])
    if large:
        moved = moved.where(F.col("other") > F.col("node")).select(F.col("other").alias("hi"), F.col("root").alias("lo"))
    else:
        moved = moved.select(F.col("other").alias("hi"), F.col("root").alias("lo")).unionAll(
            least.select(F.col("n").alias("hi"), F.col("root").alias("lo"))
        )
    return moved.where(F.col("hi") != F.col("lo")).distinct()


def components(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link.

    ``edges`` has two bigint columns a, b; loops, repeats and either direction are fine, rows
    with a null end are ignored. An empty edge table gives an empty result.
    """
    current = scratch.save(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(),
        f"{tag}-0",
    )
    state = None
    step = 0
    while True:
        step += 1
        following = scratch.save(_star(_star(current, True), False), f"{tag}-{step}")
        scratch.drop(f"{tag}-{step - 1}")
        row = following.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)")).alias("s")).first()
        current = following
        if (row["n"], row["s"]) == state:
            break
        state = (row["n"], row["s"])
    labels = current.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return labels.unionAll(current.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
