"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toxiscope.llm.common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on (u, v): neighbours move to the smallest node around.

    The minimum of a node of any degree is summed map-side first; the join
    back carries one row per edge, and adaptive skew handling splits it.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.filter("v < u")
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(low, "u")
    if large:
        moved = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of the links (u, v): the smallest node of its component.

    Ends when every node hangs directly on a root; the number of rounds grows
    with the logarithm of the longest path.
    """
    now = scratch.keep(edges.filter("u <> v").select("u", "v").distinct(), f"{name}-0")
    step = 0
    while True:
        # done when no node has two parents and no parent has a parent
        parents = now.groupBy("u").agg(F.count("*").alias("n"), F.max("v").alias("v"))
        hanging = now.select(F.col("u").alias("v")).distinct()
        left = parents.join(hanging, "v", "left_semi").select("u").unionByName(parents.filter("n > 1").select("u"))
        if step and left.isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        step += 1
        after = scratch.keep(_star(_star(now, True), False), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        now = after
