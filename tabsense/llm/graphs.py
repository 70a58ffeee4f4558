"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsense.llm.common import stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: every larger neighbour moves to a node's smallest neighbour (or the node); small star: a node and
    its smaller neighbours move to the smallest of them.  Minima are combined before the shuffle."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    moved = both.join(low, "a")
    if large:
        moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        moved = moved.where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
    return moved.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: longs): the smallest node it is connected with.

    Loops until nothing changes; every round is written to the shared folder, so a lost executor costs one round.
    Loops and repeated edges are fine; no edges give no rows.
    """
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40))).first())
    now = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, after = None, state(now)
    while before != after:
        now = stored(_stars(_stars(now, True), False), "stars")
        before, after = after, state(now)
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    loops = edges.where("a = b").select(F.col("a").alias("node")).distinct()
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
    alone = loops.join(found, "node", "left_anti").withColumn("component", F.col("node"))
    return found.unionByName(alone)
