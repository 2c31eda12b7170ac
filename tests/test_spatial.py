"""Operators against plain NumPy on small clouds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold import catalog
from terrafold.functions import geometry as g
from terrafold.operators import spatial, surface
from terrafold.plans.data import points


def cloud(spark, xyz, **more):
    rows = [(i, *map(float, p)) for i, p in enumerate(xyz)]
    return spark.createDataFrame(rows, "node_id long, x double, y double, z double")


@pytest.fixture(scope="module")
def some(spark):
    xyz = np.random.default_rng(4).normal(0, 1, (300, 3))
    return xyz, cloud(spark, xyz).cache()


def test_eigen_matches_lapack(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(200, 3, 3))
    m = np.einsum("nij,nik->njk", a, a)
    rows = [(i, *map(float, (x[0, 0], x[0, 1], x[0, 2], x[1, 1], x[1, 2], x[2, 2]))) for i, x in enumerate(m)]
    cov = spark.createDataFrame(rows, "node_id long, xx double, xy double, xz double, yy double, yz double, zz double")
    got = surface.normals(cov).orderBy("node_id").toPandas()
    values, vectors = np.linalg.eigh(m)
    assert np.allclose(got.roughness**2, values[:, 0], atol=1e-9)
    n = got[["nx", "ny", "nz"]].to_numpy()
    assert np.allclose(np.abs((n * vectors[:, :, 0]).sum(axis=1)), 1, atol=1e-7)
    assert (n[:, 2] >= 0).all()


def test_voxels_match_naive_and_do_not_depend_on_partitions(spark):
    xyz = np.random.default_rng(1).normal(0, 3, (5000, 3))
    pts = cloud(spark, xyz)
    got = surface.voxel_downsample(pts, 0.25, single=False).orderBy("node_id").toPandas()
    want: dict[tuple, list] = {}
    for p in xyz:
        want.setdefault(tuple(np.floor(p / 0.25).astype(int)), []).append(p)
    keys = sorted(want)
    assert [tuple(r) for r in got[["gx", "gy", "gz"]].to_numpy()] == keys
    assert np.allclose(got[["x", "y", "z"]], [np.mean(want[k], axis=0) for k in keys])
    again = surface.voxel_downsample(pts.repartition(7), 0.25, single=False).orderBy("node_id").toPandas()
    assert np.allclose(got[["x", "y", "z"]], again[["x", "y", "z"]]) and (got.gx == again.gx).all()


def test_voxel_size_zero_and_empty(spark):
    assert surface.voxel_downsample(cloud(spark, [(1, 2, 3), (1, 2, 3)]), 0).count() == 2
    assert surface.voxel_downsample(cloud(spark, [(1, 2, 3)]).filter("false"), 0.5).count() == 0


@pytest.mark.parametrize("start", [0.05, 0.4, 3.0])
def test_knn_is_exact_whatever_the_first_cell(some, start):
    xyz, df = some
    got = spatial.knn_join(df, df, 5, start).select("l_node_id", "rank", "r_node_id").toPandas().sort_values(["l_node_id", "rank"])
    d = np.linalg.norm(xyz[:, None] - xyz[None], axis=2)
    assert (got.r_node_id.to_numpy().reshape(-1, 5) == np.argsort(d, axis=1, kind="stable")[:, :5]).all()


def test_nearest_of_far_points(spark, some):
    xyz, df = some
    q = np.array([[50.0, -80.0, 3.0], [0, 0, 0]])
    got = spatial.nearest(cloud(spark, q), df, 0.1).orderBy("l_node_id").toPandas()
    assert got.r_node_id.tolist() == np.linalg.norm(q[:, None] - xyz[None], axis=2).argmin(axis=1).tolist()


def test_knn_by_place_is_exact_for_any_density_and_repeats(spark):
    rng = np.random.default_rng(6)
    xyz = np.concatenate([rng.normal(0, 1e-5, (300, 3)), rng.uniform(-3, 3, (200, 3)), np.tile([[0.5, 0.5, 0.5], [-0.0, 0.0, 2.0]], (40, 1)), [[900.0, 0, 0]]])
    xyz = xyz[rng.permutation(len(xyz))]
    df = cloud(spark, xyz)

    def check(left, right, k, got):
        got = got.toPandas().sort_values(["l_node_id", "rank"])
        d = np.sqrt(((left[:, None] - right[None]) ** 2).sum(axis=2))
        k = min(k, len(right))
        assert (got.l_node_id.to_numpy().reshape(-1, k)[:, 0] == np.arange(len(left))).all()
        assert (got.r_node_id.to_numpy().reshape(-1, k) == np.argsort(d, axis=1, kind="stable")[:, :k]).all()

    got = spatial.knn_by_place(df.withColumn("more", -F.col("node_id")), df, 8)
    assert got.columns == ["l_node_id", "l_x", "l_y", "l_z", "l_more", "r_node_id", "r_x", "r_y", "r_z", "d", "rank"] and got.filter("l_more <> -l_node_id").isEmpty()
    check(xyz, xyz, 8, got)
    check(xyz[:50] + 0.25, xyz[:5], 8, spatial.knn_by_place(cloud(spark, xyz[:50] + 0.25), cloud(spark, xyz[:5]), 8))
    assert spatial.knn_by_place(df.filter("false"), df, 8).isEmpty()


def test_pairs_of_vectors_grow_with_the_rows(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(spatial, "radius_join", lambda *a, f=spatial.radius_join, **b: (made.append(out := f(*a, **b)), out)[1])
    monkeypatch.setattr(spatial, "drop_stored", lambda df: None)  # the pairs are counted after the rounds
    xyz = np.random.default_rng(7).uniform(0.001, 0.049, (3000, 3))
    spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(xyz)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert catalog.knn_join_vectors(spark, str(tmp_path)).count() == 8 * 3000
    assert sum(p.count() for p in made) < 200 * 3000


def test_radius_join_and_plan(some):
    xyz, df = some
    pairs = spatial.radius_join(df, df, 0.7)
    d = np.linalg.norm(xyz[:, None] - xyz[None], axis=2)
    assert pairs.count() == (d < 0.7).sum()
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_band_search(spark, some):
    xyz, df = some
    q = df.withColumns({"nx": F.lit(0.0), "ny": F.lit(0.6), "nz": F.lit(0.8)})
    got = {r["node_id"]: (r["d"], r["dz"]) for r in spatial.nearest_in_band(q, df, 0.5, 0.2, 1.0).collect()}
    diff = xyz[None] - xyz[:, None]
    d, dz = np.hypot(diff[..., 0], diff[..., 1]), diff @ np.array([0, 0.6, 0.8])
    for i in range(len(xyz)):
        ok = (d[i] < 0.5) & (dz[i] > 0.2) & (dz[i] < 1.0)
        if not ok.any():
            assert i not in got
        else:
            assert math.isclose(got[i][0], d[i][ok].min(), rel_tol=1e-12)


def test_normals_of_a_plane_and_subset(spark):
    rng = np.random.default_rng(3)
    xyz = np.column_stack([rng.uniform(-5, 5, (600, 2)), np.zeros(600)])
    df = cloud(spark, xyz)
    full = surface.estimate_normals(df, 16, cell_size=0.5).orderBy("node_id").toPandas()
    assert (full.nz > 0.999999).all() and (full.roughness < 1e-6).all()
    part = surface.estimate_normals(df, 16, cell_size=0.5, probe=df.filter("node_id IN (5, 100, 577)")).orderBy("node_id").toPandas()
    assert np.allclose(part.slope, full.set_index("node_id").loc[[5, 100, 577]].slope)


def test_tiny_clouds_are_flat(spark):
    r = surface.estimate_normals(cloud(spark, [(0, 0, 0), (0, 0, 5)])).collect()
    assert [x["nz"] for x in r] == [1.0, 1.0]


def test_layers(spark):
    df = cloud(spark, [(0.1, 0.1, 0.0), (0.2, 0.1, 0.2), (0.1, 0.2, 3.0), (0.3, 0.3, 3.1), (5, 5, 1.0)])
    got = surface.layer_bottoms(df, 1.0, 0.4, 0.15).orderBy("node_id").toPandas()
    assert got.layer.tolist() == [1, 1, 2, 2, 1] and got.candidate.tolist() == [True, False, True, True, True]


def test_finite(spark):
    df = spark.createDataFrame([(1.0, float("nan"), 0.0), (1.0, 2.0, float("inf")), (1.0, 2.0, None), (1.0, 2.0, 3.0)], "x double, y double, z double")
    assert surface.finite(df).count() == 1


def test_finite_of_every_kind_of_number(spark):
    odd = [float("nan"), float("inf"), float("-inf"), None, -0.0, 1.7976931348623157e308, -5e-324, 2.5]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(odd)], "i int, v double")
    for kind in ("double", "float"):
        for c in "xyz":
            got = surface.finite(df.select("i", *(F.lit(1.0).cast(kind).alias(o) for o in "xyz" if o != c), F.col("v").cast(kind).alias(c)))
            want = [4, 5, 6, 7] if kind == "double" else [4, 6, 7]  # the largest double is an infinite float
            assert sorted(r["i"] for r in got.collect()) == want
    whole = spark.sql("SELECT 9223372036854775807 AS x, CAST(-7.25 AS DECIMAL(38, 10)) AS y, CAST(3 AS INT) AS z UNION ALL SELECT 1, NULL, 3")
    assert surface.finite(whole).count() == 1


def test_finite_points_of_the_tables_are_compiled(spark, tmp_path):
    rows = [(i * 37, i * 11, i * 7, i % 7, float(i % 50 + 1)) for i in range(1000)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    code = surface.finite(points(spark, str(tmp_path)))._jdf.queryExecution().debug().codegenToSeq()
    assert code.size() and all(code.apply(i)._3().maxMethodCodeSize() < 8000 for i in range(code.size()))


def test_voxels_of_the_tables_are_compiled(spark, tmp_path):
    rows = [(i * 37, i * 11, i * 7, i % 7, float(i % 50 + 1)) for i in range(1000)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # with it, code is there only after the run
    try:
        code = surface.voxel_cells(surface.finite(points(spark, str(tmp_path))), 0.5)._jdf.queryExecution().debug().codegenToSeq()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())]
    assert len(sizes) >= 2 and max(sizes) < 8000


def test_quaternions_are_unit_and_turn(spark):
    rng = np.random.default_rng(5)
    n = rng.normal(size=(100, 3))
    n[:, 2] = np.abs(n[:, 2]) + 0.1
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    yaw = rng.uniform(-3, 3, 100)
    df = spark.createDataFrame([(*map(float, v), float(y)) for v, y in zip(n, yaw)], "nx double, ny double, nz double, yaw double")
    q = df.select("nx", "ny", "nz", g.heading_quaternion(F.col("nx"), F.col("ny"), F.col("nz"), F.col("yaw")).alias("q")).select("nx", "ny", "nz", "q.*").toPandas()
    x, y, z, w = (q[c].to_numpy() for c in ("qx", "qy", "qz", "qw"))
    assert np.allclose(x * x + y * y + z * z + w * w, 1)
    up = np.column_stack([2 * (x * z + w * y), 2 * (y * z - w * x), 1 - 2 * (x * x + y * y)])
    assert np.allclose(up, q[["nx", "ny", "nz"]], atol=1e-9)
