"""Maps and plans: the operators put together, and the stored form of a map."""

from __future__ import annotations

import hashlib
import time
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrafold.config import Config
from terrafold.operators import navgraph, paths, surface
from terrafold.operators import trajectory as tr
from terrafold.store import drop_stored, scope, stored

POINT = "struct<x:double,y:double,z:double>"
PARTS = ("nodes", "obstacles", "edges")


def read_map_part(spark: SparkSession, folder: str, part: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{part}")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


class Plans(tuple):
    """(path, summary), and ``raw``: the nodes that the search went over (query_id, seq, node_id, x, y, z).

    All three read tables that :meth:`drop` deletes; those left are deleted when the process ends.
    """

    raw: DataFrame
    held: list[DataFrame]

    def __new__(cls, path: DataFrame, summary: DataFrame, raw: DataFrame, held: list[DataFrame]) -> Plans:
        self = super().__new__(cls, (path, summary))
        self.raw, self.held = raw, held
        return self

    def drop(self) -> None:
        while self.held:
            drop_stored(self.held.pop())


#: The search backend of each setting; the compiled kernels that the names stand for elsewhere give the same results.
BACKENDS = {"auto": "auto", "kernel": "kernel", "python": "kernel", "numba": "kernel", "scipy": "kernel", "relaxation": "relaxation"}


@dataclass
class TerrainMap:
    """Nodes, obstacles and edges of a cloud, with the plans over them."""

    nodes: DataFrame
    obstacles: DataFrame
    edges: DataFrame
    config: Config = field(default_factory=Config)
    cloud_points: int = 0
    build_time: float = 0.0
    marks: DataFrame | None = None

    @cached_property
    def graph(self) -> paths.Graph:
        """The graph for searches; its arrays are fetched and broadcast once."""
        return paths.Graph(self.nodes, self.edges)

    @classmethod
    def build(cls, points: DataFrame, config: Config | None = None) -> TerrainMap:
        cfg, began = config or Config(), time.time()
        nodes, obstacles = surface.build_ground(points, cfg)
        edges, nodes = navgraph.build_graph(nodes, cfg)
        out = cls(nodes, obstacles, edges, cfg, points.count())
        if cfg.alt_landmarks > 0:
            out.marks = paths.landmarks(edges, nodes, cfg.alt_landmarks, out.graph)
        out.build_time = time.time() - began
        return out

    # the stored form ---------------------------------------------------------

    def save(self, folder: str) -> None:
        """One Parquet folder for each part; the mark is written last, so a broken write is never read."""
        for part in PARTS:
            getattr(self, part).write.mode("overwrite").parquet(f"{folder}/{part}")
        spark = self.nodes.sparkSession
        spark.createDataFrame([(self.config.fingerprint(), self.cloud_points)], "fingerprint string, cloud_points long").coalesce(1).write.mode("overwrite").json(f"{folder}/mark")

    @classmethod
    def load(cls, spark: SparkSession, folder: str, config: Config) -> TerrainMap | None:
        """The stored map, or None if there is none, or none of these settings."""
        if not exists(spark, f"{folder}/mark/_SUCCESS"):
            return None
        mark = spark.read.schema("fingerprint string, cloud_points long").json(f"{folder}/mark").first()
        if mark is None or mark["fingerprint"] != config.fingerprint():
            return None
        out = cls(*(read_map_part(spark, folder, p) for p in PARTS), config, mark["cloud_points"])
        if config.alt_landmarks > 0:
            out.marks = paths.landmarks(out.edges, out.nodes, config.alt_landmarks, out.graph)
        return out

    @classmethod
    def from_pcd(cls, spark: SparkSession, path: str, config: Config | None = None) -> TerrainMap:
        """Reads a point-cloud file; with ``cache_dir``, takes the stored map of the same file and settings if there is one."""
        from terrafold.sources import pcd

        cfg = config or Config()
        key = hashlib.sha1(f"{pcd.signature(path)}|{cfg.fingerprint()}".encode()).hexdigest()[:24]
        folder = f"{cfg.cache_dir}/{key}" if cfg.cache_dir else ""
        if folder and (found := cls.load(spark, folder, cfg)) is not None:
            return found
        out = cls.build(pcd.read(spark, path), cfg)
        if folder:
            out.save(folder)
        return out

    # plans -------------------------------------------------------------------

    def snapped(self, queries: DataFrame) -> DataFrame:
        """query_id, start_id, goal_id for (query_id, start, goal); null where nothing free is near."""
        both = queries.select("query_id", F.explode(F.array(F.struct(F.lit("s").alias("end"), F.col("start").alias("p")), F.struct(F.lit("g").alias("end"), F.col("goal").alias("p")))).alias("e"))
        pts = both.select(F.struct("query_id", "e.end").alias("point_id"), "e.p.x", "e.p.y", "e.p.z")
        hit = tr.snap(pts, self.nodes, self.config.snap_radius)
        wide = hit.groupBy(F.col("point_id.query_id").alias("query_id")).agg(
            F.max(F.when(F.col("point_id.end") == "s", F.col("node_id"))).alias("start_id"), F.max(F.when(F.col("point_id.end") == "g", F.col("node_id"))).alias("goal_id")
        )
        return queries.select("query_id").join(wide, "query_id", "left")

    def search(self, snapped: DataFrame, weight: float | None = None) -> DataFrame:
        cfg = self.config
        w = cfg.heuristic_weight if weight is None else weight
        two_sided = cfg.bidirectional and self.marks is None
        return paths.shortest_paths(self.nodes, self.edges, snapped, w, two_sided, self.marks, cfg.prune_components, cfg.max_expansions, BACKENDS[cfg.search_backend], self.graph)

    def make_plans(self, queries: DataFrame, weight: float | None = None) -> Plans:
        """(path, summary) for queries (query_id, start, goal structs).

        path: query_id, seq, x, y, z, yaw, nx, ny, nz. summary: a row for each query with success, message,
        length, climb, cost, expanded, n_poses, and planning_time: the seconds that all queries together took. Failures have no
        path rows and an infinite cost. Paths begin at the nodes that start and goal snap to.
        """
        cfg, began = self.config, time.time()
        with scope() as keep:
            found = stored(self.search(self.snapped(queries), weight), "found")
            good = found.filter("success").select(F.col("query_id").alias("path_id"), F.posexplode("path").alias("seq", "node_id"))
            raw = stored(good.join(self.nodes.select("node_id", "x", "y", "z"), "node_id").select("path_id", F.col("seq").cast("long").alias("seq"), "node_id", "x", "y", "z"), "raw")
            line = raw.drop("node_id")
            if cfg.shortcut:
                line = tr.shortcut(line, tr.feasible_jumps(line, self.nodes, cfg))
            line = stored(tr.resample(line, cfg.path_resolution), "resampled")
            if cfg.smooth_iterations > 0:
                line = tr.smooth(line, cfg.smooth_iterations, cfg.smooth_weight_data, cfg.smooth_weight_smooth, self.nodes, max(1.5 * cfg.voxel_size, cfg.max_step))
            line = tr.project(line, self.nodes, 2 * cfg.voxel_size)
            line = stored(tr.surface_normals(tr.yaws(line), self.nodes, 2 * cfg.voxel_size), "line")
            keep += [found, raw, line]
        path = line.select(F.col("path_id").alias("query_id"), "seq", "x", "y", "z", "yaw", "nx", "ny", "nz")
        m = tr.metrics(line).withColumnRenamed("path_id", "query_id")
        message = F.when(F.col("start_id").isNull(), f"no free node within {cfg.snap_radius} m of the start").when(F.col("goal_id").isNull(), f"no free node within {cfg.snap_radius} m of the goal").otherwise(F.col("reason"))
        zero = lambda c, t: F.coalesce(F.col(c), F.lit(0).cast(t)).alias(c)
        took = F.lit(round(time.time() - began, 3)).alias("planning_time")
        summary = found.join(m, "query_id", "left").select("query_id", "success", message.alias("message"), zero("length", "double"), zero("climb", "double"), "cost", "expanded", zero("n_poses", "long"), took)
        return Plans(path, summary, raw.withColumnRenamed("path_id", "query_id"), keep)

    def plan_through(self, waypoints: DataFrame, weight: float | None = None) -> Plans:
        """Plans between consecutive rows of waypoints (route_id, seq, x, y, z): query_id numbers the legs of all routes."""
        w = Window.partitionBy("route_id").orderBy("seq")
        here = F.struct(*(F.col(c).cast("double").alias(c) for c in "xyz"))
        legs = waypoints.select("route_id", "seq", here.alias("start"), F.lead(here).over(w).alias("goal")).filter("goal IS NOT NULL")
        legs = surface.dense_ids(legs, ["route_id", "seq"], "query_id")
        return self.make_plans(legs.select("query_id", "start", "goal"), weight)

    def stats(self) -> dict[str, object]:
        n = self.nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(~F.col("lethal")).alias("free"), F.min("z").alias("lo"), F.max("z").alias("hi")).first()
        e = self.edges.count()
        return {
            "cloud_points": self.cloud_points, "nodes": n["nodes"], "free_nodes": n["free"], "lethal_nodes": n["nodes"] - n["free"],
            "obstacle_points": self.obstacles.count(), "edges": e // 2, "graph_mb": round((e * 12 + n["nodes"] * 8) / 1e6, 2),
            "build_time_s": round(self.build_time, 3), "z_range": [n["lo"], n["hi"]],
        }


def queries_frame(spark: SparkSession, pairs: list[tuple[tuple[float, float, float], tuple[float, float, float]]]) -> DataFrame:
    rows = [(i, tuple(map(float, s)), tuple(map(float, g))) for i, (s, g) in enumerate(pairs)]
    return spark.createDataFrame(rows, f"query_id long, start {POINT}, goal {POINT}")


__all__ = ["Plans", "TerrainMap", "exists", "queries_frame"]
