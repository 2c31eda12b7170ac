"""Navigation graph: nearest allowed neighbours, safe edges, weights, components."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.config import Config
from terrafold.functions import geometry as g
from terrafold.operators.components import connected
from terrafold.operators.spatial import knn_join, nearest
from terrafold.store import stored

#: Least and most samples on an edge.
SAMPLES = (2, 512)


def _allowed(cfg: Config) -> Column:
    dxy = g.norm2(F.col("r_x") - F.col("l_x"), F.col("r_y") - F.col("l_y"))
    return (F.col("l_node_id") != F.col("r_node_id")) & g.edge_allowed(dxy, F.abs(F.col("r_z") - F.col("l_z")), F.col("d"), cfg.tan_slope, cfg.max_step)


def candidate_edges(free: DataFrame, cfg: Config) -> DataFrame:
    """src, dst, length, rank: for each free node its nearest neighbours over allowed slopes, at most ``max_neighbors``.

    Slopes are tested before ranking, so steep neighbours never use up a node's places.
    """
    own = free.select("node_id", "x", "y", "z")
    near = knn_join(own, own, max(cfg.max_neighbors, 1), min(cfg.radius, 4 * cfg.voxel_size), radius=cfg.radius, keep=lambda: _allowed(cfg))
    return near.select(F.col("l_node_id").alias("src"), F.col("r_node_id").alias("dst"), F.col("d").alias("length"), "rank")


def _placed(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    a = nodes.select(F.col("node_id").alias("src"), *(F.col(c).alias("a" + c) for c in "xyz"))
    b = nodes.select(F.col("node_id").alias("dst"), *(F.col(c).alias("b" + c) for c in "xyz"))
    return edges.join(a, "src").join(b, "dst")


def certified(long_edges: DataFrame, free: DataFrame, lethal: DataFrame | None, cfg: Config) -> DataFrame:
    """``long_edges`` (edge_id and end points) with ``certified``: the middle alone proves the edge safe.

    Distances change along an edge no faster than its length, so enough room at the middle is enough
    everywhere.
    """
    mid = long_edges.select("edge_id", "length", *(((F.col("a" + c) + F.col("b" + c)) / 2).alias(c) for c in "xyz"))
    df = nearest(mid, free, cfg.voxel_size * 2, left_id="edge_id", radius=cfg.support)
    df = df.select(F.col("l_edge_id").alias("edge_id"), F.col("l_length").alias("length"), F.col("d").alias("df")).filter(F.col("df") + F.col("length") / 2 <= cfg.support)
    if lethal is not None:
        # a lethal node matters only within df + length <= support + length / 2 of the middle
        reach = cfg.support + cfg.radius
        dl = nearest(mid, lethal, cfg.voxel_size * 2, left_id="edge_id", radius=reach).select(F.col("l_edge_id").alias("edge_id"), F.col("d").alias("dl"))
        df = df.join(dl, "edge_id", "left").filter(F.col("dl").isNull() | (F.col("dl") - F.col("df") >= F.col("length")))
    return long_edges.join(df.select("edge_id", F.lit(True).alias("ok_")), "edge_id", "left").withColumn("certified", F.coalesce("ok_", F.lit(False))).drop("ok_")


def sampled_safe(edges: DataFrame, free: DataFrame, lethal: DataFrame | None, cfg: Config) -> DataFrame:
    """edge_id of the edges on which every sample has ground below it and no lethal node nearer by a margin.

    The longest edge sets the number of samples and the margin for all.
    """
    longest = edges.agg(F.max("length").alias("m")).first()["m"]
    if longest is None:
        return edges.select("edge_id")
    n = int(min(max(math.ceil(longest / (0.25 * cfg.voxel_size)), SAMPLES[0]), SAMPLES[1]))
    margin = longest / (n + 1)
    at = edges.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("t", F.col("i") / F.lit(float(n + 1)))
    points = at.select("edge_id", (F.col("edge_id") * 1024 + F.col("i")).alias("sample_id"), *((F.col("a" + c) + F.col("t") * (F.col("b" + c) - F.col("a" + c))).alias(c) for c in "xyz"))
    points = stored(points, "samples")
    df = nearest(points, free, cfg.voxel_size * 2, left_id="sample_id", radius=cfg.support).select(F.col("l_sample_id").alias("sample_id"), F.col("l_edge_id").alias("edge_id"), F.col("d").alias("df"))
    if lethal is not None:
        dl = nearest(points.select("sample_id", "x", "y", "z"), lethal, cfg.voxel_size * 2, left_id="sample_id", radius=cfg.support + margin).select(F.col("l_sample_id").alias("sample_id"), F.col("d").alias("dl"))
        df = df.join(dl, "sample_id", "left").filter(F.col("dl").isNull() | (F.col("dl") >= F.col("df") + margin))
    return df.groupBy("edge_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == n).select("edge_id")


def safe_edges(edges: DataFrame, nodes: DataFrame, cfg: Config) -> DataFrame:
    """``edges`` without those that run through lethal nodes or over missing ground (longer than 1.5 voxels)."""
    free, lethal = nodes.filter("NOT lethal").select("node_id", "x", "y", "z"), nodes.filter("lethal").select("node_id", "x", "y", "z")
    placed = stored(_placed(edges.withColumn("edge_id", F.monotonically_increasing_id()), nodes), "edges")
    long_ = placed.filter(F.col("length") > 1.5 * cfg.voxel_size)
    against = None if lethal.isEmpty() else lethal
    proof = stored(certified(long_, free, against, cfg), "certified")
    open_ = proof.filter("NOT certified")
    fine = proof.filter("certified").select("edge_id")
    if not open_.isEmpty():
        fine = fine.union(sampled_safe(open_, free, against, cfg))
    short = placed.filter(F.col("length") <= 1.5 * cfg.voxel_size).select("edge_id")
    return placed.join(short.union(fine), "edge_id", "left_semi").select(*edges.columns)


def weighted(edges: DataFrame, nodes: DataFrame, cfg: Config) -> DataFrame:
    """src, dst, length, w with the mean cost of both ends in the weight."""
    a = nodes.select(F.col("node_id").alias("src"), F.col("cost").cast("double").alias("ca"))
    b = nodes.select(F.col("node_id").alias("dst"), F.col("cost").cast("double").alias("cb"))
    w = g.edge_weight(F.col("length"), F.col("ca"), F.col("cb"), cfg.cost_weight)
    return edges.join(a, "src").join(b, "dst").select("src", "dst", "length", w.cast("float" if cfg.dtype_32bit else "double").alias("w"))


def both_ways(edges: DataFrame, dedupe: bool = True) -> DataFrame:
    """Every edge and its reverse; mutual picks once, by their smaller weight, unless ``dedupe`` is off."""
    two = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "length", "w"))
    return two.groupBy("src", "dst").agg(F.min("length").alias("length"), F.min("w").alias("w")) if dedupe else two


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))


def adjacency(edges: DataFrame) -> DataFrame:
    """src, nbrs: neighbours with weights, by id; lists are as short as the neighbour limit makes them."""
    return edges.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dst", "w"))).alias("nbrs"))


def neighbours_of(edges: DataFrame, node: int) -> DataFrame:
    """dst, length, w of one node's edges; the filter reaches a stored graph's scan."""
    return edges.filter(F.col("src") == node).select("dst", "length", "w")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, component (its smallest node id); nodes without edges are alone."""
    found = connected(stored(edges.filter("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct(), "pairs"))
    return nodes.select("node_id").join(found.withColumnRenamed("node", "node_id"), "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def component_sizes(comp: DataFrame) -> DataFrame:
    return comp.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges of ``old`` whose source was not looked up again, and all of ``new``."""
    return old.join(new.select("src").distinct(), "src", "left_anti").unionByName(new)


def build_graph(nodes: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """(edges src, dst, length, w both ways; nodes with ``component``)."""
    free = nodes.filter("NOT lethal")
    if free.isEmpty():
        raise RuntimeError("no free node to build a graph on")
    picked = stored(candidate_edges(free, cfg).drop("rank"), "picked")
    if picked.isEmpty():
        raise RuntimeError("no edges: use a larger connection radius")
    kept = safe_edges(picked, nodes, cfg) if cfg.edge_collision_check else picked
    edges = stored(both_ways(weighted(kept, nodes, cfg)), "graph")
    if not cfg.prune_components:
        return edges, nodes.withColumn("component", F.lit(None).cast("long"))
    return edges, stored(nodes.join(components(nodes, edges), "node_id"), "graphnodes")


__all__ = ["adjacency", "both_ways", "build_graph", "candidate_edges", "certified", "component_sizes", "components", "degrees", "neighbours_of", "replaced", "safe_edges", "sampled_safe", "weighted"]
