"""From points to classified surface nodes with costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.config import Config
from terrafold.functions import geometry as g
from terrafold.operators.spatial import knn_join, nearest_in_band, radius_join
from terrafold.store import stored


def finite(points: DataFrame) -> DataFrame:
    """Rows whose x, y and z are all finite numbers.

    Only those times 0 are 0. The test has each coordinate once: Spark copies what a coordinate is calculated from
    into every place, and code of over 8000 bytes a method isn't compiled but interpreted.
    """
    x, y, z = (F.col(c) * F.lit(0) == F.lit(0) for c in "xyz")
    return points.filter(x & y & z)


def voxel_cells(points: DataFrame, size: float, single: bool = True) -> DataFrame:
    """gx, gy, gz, x, y, z (centroid), n of every occupied cell; means in doubles, kept as floats if ``single``."""
    mean = lambda c: (F.avg(c).cast("float").cast("double") if single else F.avg(c)).alias(c)
    keyed = points.select(*(g.cell(F.col(c), size).alias(f"g{c}") for c in "xyz"), "x", "y", "z")
    return keyed.groupBy("gx", "gy", "gz").agg(mean("x"), mean("y"), mean("z"), F.count(F.lit(1)).alias("n"))


def dense_ids(df: DataFrame, order: list[str], name: str = "node_id") -> DataFrame:
    """Adds 0-based ids in the order of ``order``: sorted ranges, shifted by the rows of the ranges before.

    Only a row for each partition meets in one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("m_", F.monotonically_increasing_id()), "ids")
    part = F.shiftright("m_", 33).alias("p_")
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("n_"))
    before = Window.orderBy("p_").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("p_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("b_"))
    out = placed.withColumn("p_", F.shiftright("m_", 33)).join(F.broadcast(bases), "p_")  # one row for each partition
    return out.select((F.col("b_") + F.col("m_").bitwiseAND(F.lit((1 << 33) - 1))).alias(name), *df.columns)


def voxel_downsample(points: DataFrame, size: float, single: bool = True) -> DataFrame:
    """node_id, gx, gy, gz, x, y, z, n in cell order; ``size`` <= 0 keeps every point as it is."""
    if size <= 0:
        return dense_ids(points.select("x", "y", "z"), ["x", "y", "z"])
    return dense_ids(voxel_cells(points, size, single), ["gx", "gy", "gz"])


def layer_bottoms(points: DataFrame, size: float, gap: float, band: float = 0.0) -> DataFrame:
    """``points`` with ``layer`` (1 upwards in each column of cells), ``bottom`` (its lowest z) and ``candidate``.

    A layer begins where the step up from the point below exceeds ``gap``.
    """
    cols = [g.cell(F.col("x"), size).alias("gx_"), g.cell(F.col("y"), size).alias("gy_")]
    up = Window.partitionBy("gx_", "gy_").orderBy("z", *(["node_id"] if "node_id" in points.columns else []))
    df = points.select("*", *cols).withColumn("below_", F.lag("z").over(up))
    new = F.when(F.col("below_").isNull() | (F.col("z") - F.col("below_") > gap), 1).otherwise(0)
    df = df.withColumn("new_", new).withColumn("layer", F.sum("new_").over(up.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    df = df.withColumn("bottom", F.min("z").over(Window.partitionBy("gx_", "gy_", "layer")))
    return df.withColumn("candidate", F.col("z") - F.col("bottom") <= band).drop("gx_", "gy_", "below_", "new_")


def neighbourhoods(points: DataFrame, k: int, radius: float, cell_size: float, probe: DataFrame | None = None) -> DataFrame:
    """node_id, r_x, r_y, r_z: k rows for each probed point, itself among them.

    With ``radius`` > 0, neighbours beyond it are replaced by the point itself, as often as there are.
    """
    own = ["node_id", "x", "y", "z"]
    near = knn_join((probe or points).select(*own), points.select(*own), k, 3 * cell_size)
    out = near.select(F.col("l_node_id").alias("node_id"), *(F.col(f"r_{c}") if radius <= 0 else F.when(F.col("d") < radius, F.col(f"r_{c}")).otherwise(F.col(f"l_{c}")).alias(f"r_{c}") for c in "xyz"))
    return out


def covariances(hoods: DataFrame) -> DataFrame:
    """node_id, xx, xy, xz, yy, yz, zz: of each neighbourhood about its mean, over (rows - 1)."""
    means = Window.partitionBy("node_id")
    centred = hoods.select("node_id", *((F.col(f"r_{c}") - F.avg(f"r_{c}").over(means)).alias(c) for c in "xyz"))
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    return centred.groupBy("node_id").agg(*((F.sum(F.col(a) * F.col(b)) / (F.count(F.lit(1)) - 1)).alias(a + b) for a, b in pairs))


def normals(cov: DataFrame) -> DataFrame:
    """node_id, nx, ny, nz, slope, roughness from covariances."""
    six = [F.col(c) for c in ("xx", "xy", "xz", "yy", "yz", "zz")]
    df = cov.withColumn("l3", g.smallest_eigenvalue(*six))
    large, middle = g.other_eigenvalues(*six)
    df = df.withColumn("l1", large).withColumn("l2", middle).withColumn("n", g.plane_normal(*six, F.col("l1"), F.col("l2")))
    return df.select("node_id", "n.nx", "n.ny", "n.nz", g.slope(F.col("n.nz")).alias("slope"), g.roughness(F.col("l3")).alias("roughness"))


def estimate_normals(points: DataFrame, k: int = 16, radius: float = 0.0, cell_size: float = 0.1, probe: DataFrame | None = None) -> DataFrame:
    """node_id, nx, ny, nz, slope, roughness of the probed points; clouds of under 3 points are flat and smooth."""
    total = points.count()
    if total < 3:
        flat = (probe or points).select("node_id")
        return flat.select("node_id", F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"), F.lit(0.0).alias("slope"), F.lit(0.0).alias("roughness"))
    return normals(covariances(neighbourhoods(points, min(max(k, 4), total), radius, cell_size, probe)))


def is_surface(cfg: Config) -> Column:
    import math

    return (F.col("slope") <= math.radians(cfg.max_slope_deg)) & (F.col("roughness") <= cfg.max_roughness)


def costed(nodes: DataFrame, everything: DataFrame, obstacles: DataFrame, cfg: Config) -> DataFrame:
    """``nodes`` with clearance, cost and lethal: low ceilings and bodies in the way are lethal, their surroundings dear."""
    q = nodes.select("node_id", "x", "y", "z", "nx", "ny", "nz")
    roof = nearest_in_band(q, everything, cfg.robot_radius, cfg.max_step, cfg.robot_height).select("node_id", F.col("dz").alias("clearance"))
    wall = nearest_in_band(q, obstacles, cfg.inflation_radius, cfg.max_step, cfg.robot_height).select("node_id", F.col("d").alias("gap"))
    df = nodes.join(roof, "node_id", "left").join(wall, "node_id", "left")
    lethal = F.col("clearance").isNotNull() | F.coalesce(F.col("gap") <= cfg.robot_radius, F.lit(False))
    cost = g.inflation(F.col("gap"), cfg.robot_radius, cfg.inflation_radius, cfg.cost_scaling_factor, cfg.lethal_cost)
    return df.withColumn("lethal", lethal).withColumn("cost", F.when(F.col("lethal"), F.lit(cfg.lethal_cost)).otherwise(cost)).drop("gap")


def build_ground(points: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """(nodes, obstacles): see the schemas in the README. Raises if nothing can be stood on."""
    voxels = stored(voxel_downsample(finite(points), cfg.voxel_size, cfg.dtype_32bit), "voxels")
    probe = None
    if cfg.fast_surface_prefilter:
        probe = layer_bottoms(voxels, cfg.voxel_size, cfg.layer_gap, cfg.max_step).filter("candidate").select("node_id", "x", "y", "z")
    shape = estimate_normals(voxels, cfg.normal_k, cfg.normal_radius, cfg.voxel_size, probe)
    full = stored(voxels.join(shape, "node_id", "left").withColumn("surface", F.coalesce(is_surface(cfg), F.lit(False))), "shape")
    ground = full.filter("surface")
    if ground.isEmpty():
        raise RuntimeError("nothing to stand on: allow a larger slope or roughness")
    columns = ["x", "y", "z", "nx", "ny", "nz", "slope", "roughness"]
    nodes = stored(dense_ids(ground.select(F.col("node_id").alias("voxel_id"), *columns), ["voxel_id"]), "nodes")
    obstacles = full.filter("NOT surface").select(F.col("node_id").alias("obst_id"), "x", "y", "z")
    kind = "float" if cfg.dtype_32bit else "double"
    out = costed(nodes, voxels.select("x", "y", "z"), obstacles.select("x", "y", "z"), cfg)
    narrow = [F.col(c).cast(kind).alias(c) for c in ("nx", "ny", "nz", "slope", "roughness", "clearance", "cost")]
    return stored(out.select("node_id", "x", "y", "z", *narrow, "lethal"), "ground"), stored(obstacles, "obstacles")


__all__ = ["build_ground", "costed", "covariances", "dense_ids", "estimate_normals", "finite", "is_surface", "layer_bottoms", "neighbourhoods", "normals", "radius_join", "voxel_cells", "voxel_downsample"]
