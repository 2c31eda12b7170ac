"""Connected components by alternating large and small stars, with lineage cut in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.store import drop_stored, stored

MAX_ROUNDS = 60


def _large(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the smallest node around it."""
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b").distinct()


def _small(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the smallest of them; edges have a < b."""
    low = e.groupBy("b").agg(F.min("a").alias("m"))
    moved = e.join(low, "b").select(F.col("m").alias("x"), F.col("a").alias("y"))
    own = low.select(F.col("m").alias("x"), F.col("b").alias("y"))
    return moved.union(own).filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def connected(edges: DataFrame, keep: bool = False) -> DataFrame:
    """node, component (its smallest node) for every node of ``edges`` (a, b longs; a < b).

    Neighbour lists are never gathered: a node's smallest neighbour comes from a partial
    aggregate and goes back by a join, which Spark splits where one node is hot. Rounds grow with
    the logarithm of the longest chain. Nodes without edges aren't listed. A stored table of ``edges`` is deleted unless ``keep``.
    """
    held, before = edges, None
    for _ in range(MAX_ROUNDS):
        now = stored(_small(_large(held)), "stars")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        mark = tuple(mark)
        if held is not edges or not keep:
            drop_stored(held)
        held = now
        if mark == before or not mark[0]:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    return held.select(F.col("b").alias("node"), F.col("a").alias("component")).union(held.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
