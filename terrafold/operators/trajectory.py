"""Trajectories as rows (path_id, seq, x, y, z): metrics, resampling, smoothing, projection, headings, pulling straight."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from terrafold.config import Config
from terrafold.functions import geometry as g
from terrafold.operators.spatial import knn_join, nearest
from terrafold.store import stored


def along() -> WindowSpec:
    return Window.partitionBy("path_id").orderBy("seq")


def snap(points: DataFrame, nodes: DataFrame, radius: float, most: int = 64) -> DataFrame:
    """point_id, node_id, score: the free node with the least distance + cost / 100 among the ``most`` nearest within ``radius``.

    If all of those are lethal, the nearest free one of a list four times as long is taken, and so on; points without
    any have no row.
    """
    near = _ranked(points, nodes, radius)
    score = F.col("d") + 0.01 * F.col("r_cost").cast("double")
    # the first list (64, 256, ...) that holds a free node
    level = F.greatest(F.lit(0), F.ceil(F.log(4.0, F.col("rank") / F.lit(float(most))) - 1e-9)).cast("int")
    free = near.filter("NOT r_lethal").withColumn("level", level).withColumn("score", score)
    first = free.withColumn("first", F.min("level").over(Window.partitionBy("l_point_id"))).filter("level = first")
    best = first.groupBy("l_point_id").agg(F.min(F.struct("score", "d", "r_node_id")).alias("m"))
    return best.select(F.col("l_point_id").alias("point_id"), F.col("m.r_node_id").alias("node_id"), F.col("m.score").alias("score"))


def _ranked(points: DataFrame, nodes: DataFrame, radius: float) -> DataFrame:
    from terrafold.operators.spatial import radius_join

    pairs = radius_join(points.select("point_id", "x", "y", "z"), nodes.select("node_id", "x", "y", "z", "cost", "lethal"), radius)
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("l_point_id").orderBy("d", "r_node_id")))


def steps(path: DataFrame) -> DataFrame:
    """``path`` with dx, dy, dz (null on the first row) and ``step``, the length of the move to it."""
    df = path.select("*", *((F.col(c) - F.lag(c).over(along())).alias("d" + c) for c in "xyz"))
    return df.withColumn("step", g.norm((F.col("dx"), F.col("dy"), F.col("dz"))))


def arc_length(path: DataFrame) -> DataFrame:
    """``path`` with ``s``: the way from its start, 0 on the first row."""
    return steps(path).withColumn("s", F.sum(F.coalesce("step", F.lit(0.0))).over(along().rowsBetween(Window.unboundedPreceding, 0))).drop("dx", "dy", "dz", "step")


def metrics(path: DataFrame) -> DataFrame:
    """path_id, length, climb, n_poses."""
    up = F.greatest(F.coalesce("dz", F.lit(0.0)), F.lit(0.0))
    return steps(path).groupBy("path_id").agg(F.sum(F.coalesce("step", F.lit(0.0))).alias("length"), F.sum(up).alias("climb"), F.count(F.lit(1)).alias("n_poses"))


def resample(path: DataFrame, step: float, name: str = "path_id") -> DataFrame:
    """path_id, seq, x, y, z at multiples of ``step`` along each path, and its end.

    Each segment makes its own targets, so no range join is needed. Paths of one point, of no length,
    or with ``step`` <= 0 come back as they are.
    """
    if step <= 0:
        return path.select("path_id", "seq", "x", "y", "z")
    df = arc_length(path).withColumn("total", F.max("s").over(Window.partitionBy("path_id")))
    nxt = df.select("path_id", "seq", "x", "y", "z", "s", "total", *(F.lead(c).over(along()).alias("n" + c) for c in ("x", "y", "z", "s")))
    still = nxt.filter("total < 1e-9").select("path_id", F.col("seq").cast("long").alias("seq"), "x", "y", "z")
    seg = nxt.filter("total >= 1e-9")
    # multiples i * step with s <= i * step < next s (and below the total)
    lo, hi = F.ceil(F.col("s") / step), F.ceil(F.least("ns", "total") / step) - 1
    inside = seg.filter(F.col("ns").isNotNull()).withColumn("lo", lo).withColumn("hi", hi).filter("hi >= lo").withColumn("i", F.explode(F.sequence("lo", "hi")))
    t = (F.col("i") * step - F.col("s")) / (F.col("ns") - F.col("s"))
    rows = inside.filter(F.col("i") * step < F.col("total")).select("path_id", F.col("i").alias("seq"), *((F.col(c) + t * (F.col("n" + c) - F.col(c))).alias(c) for c in "xyz"))
    last = seg.filter(F.col("ns").isNull()).select("path_id", F.ceil(F.col("total") / step).alias("seq"), "x", "y", "z")
    return rows.unionByName(last).unionByName(still)


def smooth_once(path: DataFrame, data: float, curve: float) -> DataFrame:
    """path_id, seq, x, y, z, ox, oy, oz, cx, cy, cz: candidates of inner rows (null at both ends)."""
    def made(c: str) -> Column:
        pulled = F.col(c) + data * (F.col("o" + c) - F.col(c))
        return pulled + curve * (F.lag(c).over(along()) + F.lead(c).over(along()) - 2.0 * pulled)

    return path.select("path_id", "seq", "x", "y", "z", "ox", "oy", "oz", *(made(c).alias("c" + c) for c in "xyz"))


def smooth(path: DataFrame, iterations: int, data: float, curve: float, nodes: DataFrame | None = None, tolerance: float = 0.0) -> DataFrame:
    """Pulls inner points towards their origin and their neighbours' middle, ``iterations`` times.

    With ``nodes``, a move is made only if the nearest node is within ``tolerance`` and free.
    """
    df = path.select("path_id", "seq", "x", "y", "z", *(F.col(c).alias("o" + c) for c in "xyz"))
    for _ in range(iterations):
        cand = smooth_once(df, data, curve)
        ok = F.col("cx").isNotNull()
        if nodes is not None:
            cand = cand.withColumn("pid", F.struct("path_id", "seq"))
            inner = cand.filter(ok).select("pid", *(F.col("c" + c).alias(c) for c in "xyz"))
            near = nearest(inner, nodes.select("node_id", "x", "y", "z", "lethal"), tolerance, left_id="pid", radius=tolerance).filter("NOT r_lethal")
            cand = cand.join(near.select(F.col("l_pid").alias("pid"), F.lit(True).alias("free")), "pid", "left")
            ok = ok & F.coalesce("free", F.lit(False))
        df = cand.select("path_id", "seq", *(F.when(ok, F.col("c" + c)).otherwise(F.col(c)).alias(c) for c in "xyz"), "ox", "oy", "oz")
        if nodes is not None:
            df = stored(df, "smoothed")
    return df.select("path_id", "seq", "x", "y", "z")


def project(path: DataFrame, nodes: DataFrame, start: float, k: int = 4) -> DataFrame:
    """``path`` with z from its k nearest nodes, weighted by inverse distance."""
    pts = path.select("path_id", "seq", "x", "y", "z", F.struct("path_id", "seq").alias("pid"))
    near = knn_join(pts, nodes.select("node_id", "x", "y", "z"), k, start, left_id="pid")
    w = 1.0 / (F.col("d") + 1e-6)
    return near.groupBy(F.col("l_path_id").alias("path_id"), F.col("l_seq").alias("seq")).agg(F.first("l_x").alias("x"), F.first("l_y").alias("y"), (F.sum(w * F.col("r_z")) / F.sum(w)).alias("z"))


def yaws(path: DataFrame) -> DataFrame:
    """``path`` with ``yaw`` towards the next row; the last repeats the one before, a single row has 0."""
    ahead = F.atan2(F.lead("y").over(along()) - F.col("y"), F.lead("x").over(along()) - F.col("x"))
    df = path.withColumn("yaw_", ahead)
    return df.withColumn("yaw", F.coalesce("yaw_", F.lag("yaw_").over(along()), F.lit(0.0))).drop("yaw_")


def quaternions(poses: DataFrame) -> DataFrame:
    """``poses`` (with yaw, nx, ny, nz) with qx, qy, qz, qw."""
    return poses.withColumn("q_", g.heading_quaternion(F.col("nx"), F.col("ny"), F.col("nz"), F.col("yaw"))).select("*", "q_.qx", "q_.qy", "q_.qz", "q_.qw").drop("q_")


def surface_normals(path: DataFrame, nodes: DataFrame, start: float) -> DataFrame:
    """``path`` with nx, ny, nz of the nearest node."""
    pts = path.withColumn("pid", F.struct("path_id", "seq"))
    near = nearest(pts.select("pid", "x", "y", "z"), nodes.select("node_id", "x", "y", "z", "nx", "ny", "nz"), start, left_id="pid")
    return pts.join(near.select(F.col("l_pid").alias("pid"), *(F.col("r_n" + c).alias("n" + c) for c in "xyz")), "pid").drop("pid")


def feasible_jumps(path: DataFrame, nodes: DataFrame, cfg: Config) -> DataFrame:
    """path_id, i, j: straight jumps of 2 to ``lookahead`` rows over supported, free ground.

    The longest candidate from a row sets the number of samples for all jumps from it.
    """
    a = path.select("path_id", F.col("seq").alias("i"), *(F.col(c).alias("a" + c) for c in "xyz"))
    b = path.select("path_id", F.col("seq").alias("j"), *(F.col(c).alias("b" + c) for c in "xyz"))
    # an equality on blocks of rows bounds the pairs to 2 * lookahead for each row
    span = cfg.lookahead
    left = a.withColumn("blk", F.explode(F.array(F.floor(F.col("i") / span), F.floor(F.col("i") / span) + 1)))
    pairs = left.join(b.withColumn("blk", F.floor(F.col("j") / span)), ["path_id", "blk"]).filter((F.col("j") >= F.col("i") + 2) & (F.col("j") <= F.col("i") + span))
    d = (F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("bz") - F.col("az"))
    pairs = pairs.withColumn("len", g.norm(d)).filter(g.edge_allowed(g.norm2(d[0], d[1]), F.abs(d[2]), F.col("len"), cfg.tan_slope, cfg.max_step))
    most = F.max("len").over(Window.partitionBy("path_id", "i"))
    n = F.greatest(F.floor(most / (0.5 * cfg.voxel_size)), F.lit(1)).cast("int")
    pairs = stored(pairs.withColumn("n", n).withColumn("jump_id", F.monotonically_increasing_id()).drop("blk"), "jumps")
    at = pairs.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n")))).withColumn("t", F.col("k") / F.col("n"))
    pts = at.select("jump_id", "n", F.struct("jump_id", "k").alias("pid"), *((F.col("a" + c) + F.col("t") * (F.col("b" + c) - F.col("a" + c))).alias(c) for c in "xyz"))
    near = nearest(pts, nodes.select("node_id", "x", "y", "z", "lethal"), cfg.support, left_id="pid", radius=cfg.support).filter("NOT r_lethal")
    good = near.groupBy(F.col("l_jump_id").alias("jump_id")).agg(F.count(F.lit(1)).alias("m"))
    return pairs.join(good, "jump_id").filter(F.col("m") == F.col("n") + 1).select("path_id", "i", "j")


def shortcut(path: DataFrame, jumps: DataFrame) -> DataFrame:
    """The rows of ``path`` that a greedy walk of farthest jumps visits (else the next row), numbered anew."""
    far = jumps.groupBy("path_id", "i").agg(F.max("j").alias("j"))
    ends = path.groupBy("path_id").agg(F.max("seq").alias("last"))
    nxt = path.select("path_id", F.col("seq").alias("i")).join(far, ["path_id", "i"], "left").join(ends, "path_id").filter("i < last").select("path_id", "i", F.coalesce("j", F.col("i") + 1).cast("long").alias("j"))

    def walk(steps: pd.DataFrame) -> pd.DataFrame:
        """The rows visited from 0, in one pass over a path's steps."""
        to, at, out = dict(zip(steps.i.tolist(), steps.j.tolist(), strict=True)), 0, [0]
        while at in to:
            at = to[at]
            out.append(at)
        return pd.DataFrame({"path_id": steps.path_id.iloc[0], "seq": out})

    kind = path.schema["path_id"].dataType.simpleString()
    seen = nxt.select("path_id", F.col("i").cast("long").alias("i"), "j").groupBy("path_id").applyInPandas(walk, f"path_id {kind}, seq long")
    alone = ends.filter("last = 0").select("path_id", F.lit(0).cast("long").alias("seq"))
    kept = path.withColumn("seq", F.col("seq").cast("long")).join(seen.union(alone), ["path_id", "seq"], "left_semi")
    return kept.select("path_id", (F.row_number().over(along()) - 1).cast("long").alias("seq"), "x", "y", "z")
