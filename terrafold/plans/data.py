"""Point clouds and trajectories derived from the driver's tables, in Spark and in SQL, and the map that queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrafold.config import Config
from terrafold.plans.planner import TerrainMap

CFG = Config(
    voxel_size=0.5, robot_radius=0.6, robot_height=1.2, max_roughness=0.2, normal_k=12, inflation_radius=1.2,
    connection_radius=2.0, max_neighbors=8, snap_radius=1.5, path_resolution=0.5, lookahead=12,
)

POINTS_SQL = """pts AS (
  SELECT CASE WHEN wall THEN 5 + q ELSE CASE k WHEN 8 THEN 8 + u / 3 WHEN 9 THEN 13 + (u / 24 - 0.5::DOUBLE) * 0.7::DOUBLE ELSE u END END AS x,
         CASE k WHEN 8 THEN 9 + v * 4 / 14 WHEN 9 THEN 5 + (v / 14 - 0.5::DOUBLE) * 0.7::DOUBLE ELSE v END AS y,
         CASE WHEN wall THEN (h % 260) / 100::DOUBLE ELSE CASE k WHEN 8 THEN u / 3 * 0.375::DOUBLE + q WHEN 9 THEN (h % 120) / 100::DOUBLE ELSE q END END AS z
  FROM (SELECT *, (k = 7 AND (v < 6 OR v > 7.6::DOUBLE)) AS wall FROM (
    SELECT ((l_orderkey * 7919 + l_linenumber * 104729) % 2400) / 100::DOUBLE AS u, ((l_partkey * 7907 + l_suppkey * 31) % 1400) / 100::DOUBLE AS v,
           l_suppkey % 10 AS k, l_quantity / 5000::DOUBLE AS q, l_partkey AS h FROM lineitem)))"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y, z: a floor of 24 m by 14 m, a wall with a door, a ramp above the floor and a pillar."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    u = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 2400 / 100.0
    v = (F.col("l_partkey") * 7907 + F.col("l_suppkey") * 31) % 1400 / 100.0
    df = t.select(u.alias("u"), v.alias("v"), (F.col("l_suppkey") % 10).alias("k"), (F.col("l_quantity") / 5000.0).alias("q"), F.col("l_partkey").alias("h"))
    k, q, h, u, v = (F.col(c) for c in "kqhuv")
    wall = (k == 7) & ((v < 6) | (v > 7.6))
    x = F.when(wall, 5 + q).when(k == 8, 8 + u / 3).when(k == 9, 13 + (u / 24 - 0.5) * 0.7).otherwise(u)
    y = F.when(k == 8, 9 + v * 4 / 14).when(k == 9, 5 + (v / 14 - 0.5) * 0.7).otherwise(v)
    z = F.when(wall, h % 260 / 100.0).when(k == 8, u / 3 * 0.375 + q).when(k == 9, h % 120 / 100.0).otherwise(q)
    return df.select(x.alias("x"), y.alias("y"), z.alias("z"))


TRACKS_SQL = """trk AS (
  SELECT user_id AS path_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
         (event_id * 7919 % 1000) / 100::DOUBLE AS x, (event_id * 104729 % 1000) / 100::DOUBLE AS y, (event_id * 31 % 300) / 100::DOUBLE AS z FROM events)"""


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path_id, seq, x, y, z: each user's events in time order, placed by their id."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    place = lambda m, n: F.col("event_id") * m % n / 100.0
    return e.select(F.col("user_id").alias("path_id"), seq.cast("long").alias("seq"), place(7919, 1000).alias("x"), place(104729, 1000).alias("y"), place(31, 300).alias("z"))


SNAPS_SQL = """asked AS (SELECT c_custkey AS point_id, (c_custkey * 7919 % 2400) / 100::DOUBLE AS x, (c_custkey * 104729 % 1400) / 100::DOUBLE AS y, 0.1::DOUBLE AS z FROM customer)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_id, x, y, z: points on the floor, one for each customer."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.col("c_custkey").alias("point_id"), (F.col("c_custkey") * 7919 % 2400 / 100.0).alias("x"), (F.col("c_custkey") * 104729 % 1400 / 100.0).alias("y"), F.lit(0.1).alias("z"))


_maps: dict[tuple[str, str], TerrainMap] = {}


def terrain(spark: SparkSession, sf_dir: str) -> TerrainMap:
    """The map of :func:`points`, built once for each application and folder and kept in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _maps:
        _maps[key] = TerrainMap.build(points(spark, sf_dir), CFG)
    return _maps[key]


def r6(c: Column | str, name: str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)
