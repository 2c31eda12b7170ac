"""The scene end to end: map, graph, searches, plans, files, service."""

import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.config import Config
from terrafold.operators import navgraph, paths
from terrafold.operators import trajectory as tr
from terrafold.plans.planner import TerrainMap, queries_frame
from terrafold.sources import pcd, scene, sinks

CFG = Config(voxel_size=0.4, max_neighbors=8, connection_radius=1.4, normal_k=10, robot_radius=0.4, inflation_radius=0.8, path_resolution=0.4, lookahead=10)


@pytest.fixture(scope="module")
def terrain(spark):
    return TerrainMap.build(scene.scene(spark, density=25.0), CFG)


@pytest.fixture(scope="module")
def free_ids(terrain):
    big = terrain.nodes.filter("NOT lethal").groupBy("component").count().orderBy(F.desc("count")).first()["component"]
    return [r["node_id"] for r in terrain.nodes.filter((F.col("component") == big) & ~F.col("lethal")).orderBy("node_id").collect()]


def test_map_basics(terrain):
    s = terrain.stats()
    assert s["nodes"] == s["free_nodes"] + s["lethal_nodes"] and s["lethal_nodes"] > 0 and s["obstacle_points"] > 0
    assert s["z_range"][1] > 2.5
    assert terrain.nodes.filter("lethal AND cost <> 254").count() == 0


def test_graph_invariants(terrain):
    e = terrain.edges.toPandas()
    assert not e.duplicated(["src", "dst"]).any()
    back = e.merge(e, left_on=["src", "dst"], right_on=["dst", "src"])
    assert len(back) == len(e)
    lethal = {r["node_id"] for r in terrain.nodes.filter("lethal").collect()}
    assert not lethal & (set(e.src) | set(e.dst))
    assert (e.length < CFG.radius).all()


def test_edges_keep_clear_of_lethal_nodes(terrain):
    n = terrain.nodes.toPandas().set_index("node_id")
    e = terrain.edges.filter("src < dst").toPandas()
    a, b = (n.loc[e[c], ["x", "y", "z"]].to_numpy() for c in ("src", "dst"))
    lethal, free = (n[n.lethal == v][["x", "y", "z"]].to_numpy() for v in (True, False))
    long_ = np.flatnonzero(e.length > 1.5 * CFG.voxel_size)
    assert len(long_)
    for i in long_[::7]:
        t = np.linspace(0, 1, 33)[:, None]
        p = a[i] + t * (b[i] - a[i])
        near = [np.linalg.norm(p[:, None] - q[None], axis=2).min(axis=1) for q in (lethal, free)]
        assert (near[0] - near[1] >= -1e-9).all()


def test_collision_check_removes_edges(terrain):
    free = terrain.nodes.filter("NOT lethal")
    every = navgraph.candidate_edges(free, CFG).drop("rank")
    kept = navgraph.safe_edges(every, terrain.nodes, CFG)
    assert kept.count() < every.count()


def test_searches_agree(spark, terrain, free_ids):
    rng = np.random.default_rng(1)
    pairs = [(i, int(a), int(b)) for i, (a, b) in enumerate(rng.choice(free_ids, (12, 2)))] + [(99, free_ids[0], free_ids[0])]
    q = spark.createDataFrame(pairs, "query_id long, start_id long, goal_id long")
    marks = paths.landmarks(terrain.edges, terrain.nodes, 3)
    run = lambda **how: paths.shortest_paths(terrain.nodes, terrain.edges, q, **how).toPandas().set_index("query_id").sort_index()
    dij, star, alt, two = run(weight=0.0), run(), run(marks=marks), run(two_sided=True)
    slow = paths.by_relaxation(terrain.edges, q).toPandas().set_index("query_id").sort_index()
    for other in (star, alt, two, slow):
        assert np.allclose(dij.cost, other.cost, rtol=1e-6) and other.success.all()
    assert star.expanded.sum() <= dij.expanded.sum() and alt.expanded.sum() <= star.expanded.sum()
    assert dij.loc[99].cost == 0 and list(dij.loc[99].path) == [free_ids[0]]
    bounded = run(weight=2.0)
    assert (bounded.cost <= 2 * dij.cost + 1e-6).all()
    w = {(r["src"], r["dst"]): r["w"] for r in terrain.edges.collect()}
    for frame in (star, slow):
        for r in frame.itertuples():
            p = list(r.path)
            assert math.isclose(sum(w[a, b] for a, b in zip(p, p[1:])), r.cost, rel_tol=1e-6, abs_tol=1e-9)


def test_sql_table_function(spark, terrain, free_ids):
    paths.register_udtf(terrain.nodes, terrain.edges)
    got = spark.sql(f"SELECT * FROM shortest_path({free_ids[0]}, {free_ids[-1]}) ORDER BY seq").toPandas()
    q = spark.createDataFrame([(0, free_ids[0], free_ids[-1])], "query_id long, start_id long, goal_id long")
    want = paths.shortest_paths(terrain.nodes, terrain.edges, q).first()
    assert got.node_id.tolist() == want["path"] and math.isclose(got.cost.iloc[-1], want["cost"], rel_tol=1e-9)
    first = navgraph.neighbours_of(terrain.edges, free_ids[0])
    assert first.count() == navgraph.degrees(terrain.edges).filter(F.col("src") == free_ids[0]).first()["degree"]


def test_unreachable_and_missing_nodes(spark, terrain, free_ids):
    lethal = terrain.nodes.filter("lethal").first()["node_id"]
    q = spark.createDataFrame([(0, free_ids[0], lethal), (1, free_ids[0], 10**9), (2, None, free_ids[0])], "query_id long, start_id long, goal_id long")
    got = paths.shortest_paths(terrain.nodes, terrain.edges, q).toPandas()
    assert not got.success.any() and (got.expanded == 0).all() and np.isinf(got.cost).all()


def test_both_backends_give_the_same_rows(spark):
    rng = np.random.default_rng(3)
    at = [(i, float(i % 6), float(i // 6), 0.0, 1 if i < 30 else 2, False) for i in range(36)]
    nodes = spark.createDataFrame(at, "node_id long, x double, y double, z double, component long, lethal boolean")
    pairs = [(i, j) for i in range(36) for j in range(36) if abs(at[i][1] - at[j][1]) + abs(at[i][2] - at[j][2]) == 1 and at[i][4] == at[j][4] and i < j]
    w = {p: 1 + float(rng.random()) for p in pairs}
    edges = spark.createDataFrame([(i, j, x) for (i, j), x in w.items()] + [(j, i, x) for (i, j), x in w.items()], "src long, dst long, w float")
    q = spark.createDataFrame([(0, 0, 29), (1, 5, 5), (2, 0, 33), (3, 0, 99), (4, None, 0), (5, 2, None), (6, 29, 0), (7, 31, 35)], "query_id long, start_id long, goal_id long")
    run = lambda **how: paths.shortest_paths(nodes, edges, q, **how).toPandas().set_index("query_id").sort_index()
    for how in ({}, {"prune": False}, {"max_expansions": 3}):
        a, b = run(backend="kernel", **how), run(backend="relaxation", **how)
        assert np.allclose(a.cost, b.cost, rtol=1e-6) and a.success.tolist() == b.success.tolist() and a.reason.tolist() == b.reason.tolist()
        assert [list(p) for p in a.path] == [list(p) for p in b.path]  # weights are random, so best paths are unique
    assert a.reason[0] == "expansion limit" and not a.success[0]
    with pytest.raises(ValueError):
        run(backend="other")


def test_parent_trace_has_no_limit_of_rows_or_steps(spark):
    deep = spark.range(20001).select(F.col("id").alias("node"), (F.col("id") - 1).alias("parent"))
    got = paths.parent_trace(deep, spark.createDataFrame([(20000,), (3,), (3,), (70000,)], "leaf long"))
    assert got.columns == ["leaf", "node", "step"] and got.filter("leaf <> 3").count() == 20002
    assert sorted(map(tuple, got.filter("leaf = 3").collect())) == sorted([(3, 3 - i, i) for i in range(4)] * 2)
    assert got.filter("leaf = 20000 AND node <> 20000 - step").isEmpty()
    tree = spark.range(80000).select(F.col("id").alias("node"), F.when(F.col("id") >= 2, F.shiftright("id", 1)).alias("parent"))
    walk = paths.parent_trace(tree, tree.select(F.col("node").alias("leaf")))
    assert walk.count() == 2 + sum(n.bit_length() for n in range(2, 80000)) > 1_000_000
    assert walk.filter("node <> shiftright(leaf, CAST(step AS INT))").isEmpty()
    assert paths.parent_trace(tree.filter("node < 2"), tree.filter("node < 2").select(F.col("node").alias("leaf"))).count() == 2
    ring = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "node long, parent long")
    with pytest.raises(ValueError, match="circle"):
        paths.parent_trace(ring, ring.select(F.col("node").alias("leaf")))


def test_expansion_limits(terrain, free_ids):
    k = terrain.graph.kernel()
    _, cost, seen, _ = k.best_first(k.index(free_ids[0]), k.index(free_ids[-1]), 1.0, 10**6)
    assert k.best_first(k.index(free_ids[0]), k.index(free_ids[-1]), 1.0, seen)[1] == cost
    _, two, both, _ = k.two_sided(k.index(free_ids[0]), k.index(free_ids[-1]), 1.0, 10**6)
    assert math.isclose(two, cost, rel_tol=1e-6)
    assert k.two_sided(k.index(free_ids[0]), k.index(free_ids[-1]), 1.0, both // 2) == ([], math.inf, both // 2 + 1, "expansion limit")
    assert k.two_sided(k.index(free_ids[0]), k.index(free_ids[-1]), 2.0, 10**6)[1] <= 2 * cost + 1e-6
    assert both <= k.two_sided(k.index(free_ids[0]), k.index(free_ids[-1]), 0.0, 10**6)[2]


def test_kernel_and_relaxation_distances(terrain, free_ids):
    a = paths.reachable_set(terrain.edges, free_ids[0], 4.0).toPandas().set_index("node").dist.sort_index()
    seeds = terrain.edges.sparkSession.createDataFrame([(0, free_ids[0])], "source long, node long")
    b = paths.sssp(terrain.edges, seeds, 4.0).toPandas().set_index("node").dist.sort_index()
    assert a.index.equals(b.index) and np.allclose(a, b)


def test_plans(spark, terrain):
    q = queries_frame(spark, [((2, 2, 0), (22, 2, 0)), ((2, 2, 0), (22, 12, 3)), ((2, 2, 0), (300, 0, 0))])
    path, summary = terrain.make_plans(q)
    s = summary.toPandas().set_index("query_id").sort_index()
    assert s.success.tolist() == [True, True, False]
    assert s.loc[2].cost == math.inf and s.loc[2].n_poses == 0 and "goal" in s.loc[2].message
    assert s.loc[1].climb > 2.0 and s.loc[0].length >= 19.5
    p = tr.quaternions(path.filter("query_id = 1")).orderBy("seq").toPandas()
    assert np.allclose(p.qx**2 + p.qy**2 + p.qz**2 + p.qw**2, 1)
    step = np.linalg.norm(np.diff(p[["x", "y", "z"]].to_numpy(), axis=0), axis=1)
    assert step.max() < 1.0 and p.z.max() > 2.5
    payload = {r["query_id"]: json.loads(r["payload"]) for r in sinks.payloads(path, summary).collect()}
    assert payload[2]["cost"] is None and payload[2]["path"]["x"] == [] and len(payload[1]["path"]["yaw"]) == len(p)


def test_plan_through(spark, terrain):
    wp = spark.createDataFrame([(0, 0, 2.0, 2.0, 0.0), (0, 1, 22.0, 2.0, 0.0), (0, 2, 900.0, 0.0, 0.0)], "route_id long, seq long, x double, y double, z double")
    assert terrain.plan_through(wp)[1].orderBy("query_id").toPandas().success.tolist() == [True, False]


def test_stored_map(spark, terrain, tmp_path):
    terrain.save(str(tmp_path / "m"))
    back = TerrainMap.load(spark, str(tmp_path / "m"), CFG)
    assert back.nodes.count() == terrain.nodes.count() and back.edges.count() == terrain.edges.count()
    assert TerrainMap.load(spark, str(tmp_path / "m"), CFG.but(edge_collision_check=False)) is None
    assert TerrainMap.load(spark, str(tmp_path / "m"), CFG.but(heuristic_weight=5.0)) is not None
    assert TerrainMap.load(spark, str(tmp_path / "none"), CFG) is None


def test_config(tmp_path):
    assert CFG.fingerprint() != CFG.but(voxel_size=0.2).fingerprint() and CFG.fingerprint() == CFG.but(heuristic_weight=5.0).fingerprint()
    assert not Config.compat().edge_collision_check
    (tmp_path / "c.yaml").write_text("voxel_size: 0.3\nunknown: 1\nsearch_backend: python\n")
    c = Config.from_yaml(str(tmp_path / "c.yaml"))
    assert c.voxel_size == 0.3 and c.search_backend == "python"
    from terrafold.__main__ import config_of, parser

    args = parser().parse_args(["plan", "demo", "--goal", "1", "2", "0", "--compat", "--config", str(tmp_path / "c.yaml"), "--max-step", "0.1"])
    c = config_of(args)
    assert (c.voxel_size, c.max_step, c.edge_collision_check) == (0.3, 0.1, False)


def _lzf_literals(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 32]) - 1]) + data[i : i + 32] for i in range(0, len(data), 32))


def test_lzf():
    assert pcd.lzf_expand(_lzf_literals(b"x" * 70), 70) == b"x" * 70
    assert pcd.lzf_expand(bytes([2]) + b"abc" + bytes([4 << 5, 2]), 9) == b"abcabcabc"
    assert pcd.lzf_expand(bytes([0]) + b"a" + bytes([7 << 5, 3, 0]), 13) == b"a" * 13
    with pytest.raises(ValueError):
        pcd.lzf_expand(bytes([4 << 5, 9]), 6)
    with pytest.raises(ValueError):
        pcd.lzf_expand(bytes([0]) + b"a", 2)


@pytest.mark.parametrize("ascii_", [False, True])
def test_pcd_round_trip(spark, tmp_path, ascii_):
    pts = scene.scene(spark, density=3.0)
    pcd.write(pts.select("x", "y", "z", F.col("point_id").cast("float").alias("intensity")), str(tmp_path), ascii_)
    assert pcd.read(spark, str(tmp_path)).columns == ["x", "y", "z"]
    a = np.array(pts.select("x", "y", "z").collect())
    b = np.array(pcd.read(spark, str(tmp_path), extra=True, records_=100).select("x", "y", "z").collect())
    assert a.shape == b.shape and np.allclose(np.sort(a, axis=0), np.sort(b, axis=0), atol=1e-4)


def test_pcd_compressed_with_repeats_and_unsigned(spark, tmp_path):
    cols = [np.array(v, "<f4") for v in ([1, 2, np.nan], [3, 4, 5], [6, 7, 8])] + [np.array([250, 3, 9], "u1"), np.array([1, 2, 3], "<i2"), np.array([4, 5, 6], "<i2")]
    blob = b"".join(c.tobytes() for c in cols)
    packed = _lzf_literals(blob)
    head = "# c\nVERSION .7\nFIELDS x y z u n\nSIZE 4 4 4 1 2\nTYPE F F F U I\nCOUNT 1 1 1 1 2\nWIDTH 3\nHEIGHT 1\nDATA binary_compressed\n"
    p = tmp_path / "c.pcd"
    p.write_bytes(head.encode() + struct.pack("<II", len(packed), len(blob)) + packed)
    got = pcd.read(spark, str(p), extra=True).orderBy("x").collect()
    assert [tuple(r) for r in got] == [(1.0, 3.0, 6.0, 250, 1, 4), (2.0, 4.0, 7.0, 3, 2, 5)]
    with pytest.raises(ValueError):
        pcd.parse_header(b"VERSION .7\nFIELDS x\n")


def test_from_pcd_uses_the_stored_map(spark, tmp_path):
    pcd.write(scene.scene(spark, density=6.0).select("x", "y", "z").coalesce(1), str(tmp_path / "in"))
    file = pcd.files_of(str(tmp_path / "in"))[0]
    cfg = Config(voxel_size=0.8, max_neighbors=6, connection_radius=2.5, normal_k=8, max_roughness=0.3, cache_dir=str(tmp_path / "maps"))
    first = TerrainMap.from_pcd(spark, file, cfg)
    again = TerrainMap.from_pcd(spark, file, cfg)
    assert again.build_time == 0.0 and again.edges.count() == first.edges.count()


def test_trajectory_edges(spark):
    one = spark.createDataFrame([(0, 0, 1.0, 2.0, 3.0)], "path_id long, seq long, x double, y double, z double")
    assert tr.resample(one, 0.5).count() == 1 and tr.yaws(one).first()["yaw"] == 0.0 and tr.metrics(one).first()["length"] == 0.0
    line = spark.createDataFrame([(0, i, float(x), 0.0, 0.0) for i, x in enumerate((0, 1, 1, 2.2))], one.schema)
    got = tr.resample(line, 0.5).orderBy("seq").toPandas()
    assert np.allclose(got.x, [0, 0.5, 1.0, 1.5, 2.0, 2.2])


def test_service_answers(spark, terrain):
    from terrafold.serving import Service

    s = Service(spark, terrain, (2.0, 2.0, 0.0))
    code, out = s.answer("POST", "/goal", {"x": 10.0, "y": 2.0, "z": 0.0})
    assert code == 200 and out["success"] and s.pose[0] > 9
    assert s.answer("GET", "/pose", {})[1]["pose"][0] > 9 and s.answer("GET", "/nothing", {})[0] == 404
    assert "<canvas" in s.answer("GET", "/", {})[1]


def test_service_requests(spark, terrain):
    import threading
    import urllib.request

    from terrafold import serving, store

    service = serving.Service(spark, terrain, (2.0, 2.0, 0.0))
    assert service.answer("POST", "/goal", {})[0] == 400 and service.answer("POST", "/plan", {"x": 1, "y": 2, "z": 0})[0] == 400 and service.answer("POST", "/pose", [1])[0] == 400
    assert service.answer("POST", "/pose", {"pose": [1, 2, 0]}) == (200, {"ok": True, "pose": [1.0, 2.0, 0.0]})
    http = serving.server(service, port=0)
    port = http.server_address[1]
    threading.Thread(target=http.serve_forever, daemon=True).start()
    try:
        with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{port}/goal", method="OPTIONS"), timeout=10) as r:
            assert r.status == 204 and "POST" in r.headers["Access-Control-Allow-Methods"]
        assert serving.ask("/pose", port=port) == {"pose": [1.0, 2.0, 0.0]} and serving.ask("/none", port=port) == {"error": "not found"}
        held = len(store._tables)
        for x in (6.0, 8.0, 10.0):
            out = serving.publish_goal(x, 2.0, 0.0, port=port)
            assert out["success"] and out["planning_time"] > 0
        assert len(store._tables) <= held + 3  # those of the plan that is shown
    finally:
        http.shutdown()


def test_pcd_chunks_and_split_ascii(spark, tmp_path):
    rng = np.random.default_rng(0)
    xyz = rng.normal(0, 9, (1000, 3))
    xyz[7] = np.nan
    head = "VERSION .7\nFIELDS x y z big\nSIZE 4 4 4 8\nTYPE F F F U\nCOUNT 1 1 1 1\nWIDTH 1000\nHEIGHT 1\nDATA ascii\n"
    (tmp_path / "a.pcd").write_text(head + "".join(f"{x:.4f} {y:.4f} {z:.4f} {i}\n" for i, (x, y, z) in enumerate(xyz))[:-1])
    got = pcd.read(spark, str(tmp_path / "a.pcd"), extra=True, records_=40)
    assert got.rdd.getNumPartitions() > 10
    rows = sorted((int(r["big"]), round(r["x"], 3)) for r in got.collect())
    assert [i for i, _ in rows] == [i for i in range(1000) if i != 7] and all(abs(x - xyz[i, 0]) < 2e-3 for i, x in rows)
    parts = list(pcd.chunks(str(tmp_path / "a.pcd"), 70, "f8"))
    assert max(map(len, parts)) <= 70 and np.allclose(np.concatenate(parts), np.delete(xyz, 7, axis=0), atol=1e-4)
    names = pcd.parse_header(b"# c\r\nFIELDS _ x _ n\r\nSIZE 1 4 1 2\nTYPE U F U I\nCOUNT 2 1 1 2\nWIDTH 2\nHEIGHT 3\nDATA Binary\n\n \n").names
    assert names == ["__0", "x", "_", "n_0", "n_1"] or len(set(names)) == 6


def test_pose_stream(spark, tmp_path):
    from terrafold.streaming.streams import with_poses

    rows = [(1, i, float(i), 0.0, 0.0) for i in range(3)] + [(2, 9, 5.0, 5.0, 0.0)]
    df = spark.createDataFrame(rows, "robot_id long, query_id long, gx double, gy double, gz double")
    df.write.parquet(str(tmp_path / "g"))
    q = with_poses(spark.readStream.schema(df.schema).parquet(str(tmp_path / "g"))).writeStream.format("memory").queryName("poses").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r["query_id"]: r["sx"] for r in spark.table("poses").collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 1.0, 9: 5.0}
