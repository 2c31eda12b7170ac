"""Unbounded inputs: voxels that grow with new points, goals answered as they come, poses that follow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.functions.geometry import cell
from terrafold.plans.planner import TerrainMap

POSE_STATE = "x double, y double, z double"
POSE_ROWS = "robot_id long, query_id long, sx double, sy double, sz double, gx double, gy double, gz double"


def voxel_stream(points: DataFrame, size: float) -> DataFrame:
    """gx, gy, gz, sx, sy, sz, n: sums and counts of a stream of points; divide for centroids (update or complete mode)."""
    keyed = points.select(*(cell(F.col(c), size).alias(f"g{c}") for c in "xyz"), "x", "y", "z")
    return keyed.groupBy("gx", "gy", "gz").agg(*(F.sum(c).alias(f"s{c}") for c in "xyz"), F.count(F.lit(1)).alias("n"))


def windowed_voxels(points: DataFrame, size: float, window: str, lateness: str, ts: str = "ts") -> DataFrame:
    """The same by event-time windows; rows later than ``lateness`` are dropped by the watermark."""
    keyed = points.withWatermark(ts, lateness).select(F.window(ts, window).alias("w"), *(cell(F.col(c), size).alias(f"g{c}") for c in "xyz"))
    return keyed.groupBy("w", "gx", "gy", "gz").agg(F.count(F.lit(1)).alias("n"))


def with_poses(goals: DataFrame) -> DataFrame:
    """Goals (robot_id, query_id, gx, gy, gz) of a stream with the start of each: the robot's last goal (first: its own goal)."""

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        last = state.get if state.exists else None
        for f in frames:
            f = f.sort_values("query_id").copy()
            starts = []
            for r in f.itertuples(index=False):
                now = (r.gx, r.gy, r.gz)
                starts.append(last or now)
                last = now
            f[["sx", "sy", "sz"]] = starts
            yield f[["robot_id", "query_id", "sx", "sy", "sz", "gx", "gy", "gz"]]
        if last is not None:
            state.update(last)

    return goals.groupBy("robot_id").applyInPandasWithState(follow, POSE_ROWS, POSE_STATE, "append", "NoTimeout")


def serve_goals(goals: DataFrame, terrain: TerrainMap, sink: Callable[[DataFrame, DataFrame, int], None], checkpoint: str):  # noqa: ANN201
    """Starts a query that plans each micro-batch of (query_id, start, goal) against a fixed map and hands (path, summary, batch) on.

    The two read tables that go when ``sink`` returns.
    """

    def batch(df: DataFrame, number: int) -> None:
        plans = terrain.make_plans(df.select("query_id", "start", "goal"))
        try:
            sink(*plans, number)
        finally:
            plans.drop()

    return goals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
