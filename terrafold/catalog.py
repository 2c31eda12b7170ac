"""All registered queries of the spatial engine with their SQL twins.

Every query runs over its whole tables. Those on the shared map reuse one stored build of it.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions import geometry as g
from terrafold.operators import navgraph, paths, spatial, surface
from terrafold.operators import trajectory as tr
from terrafold.plans import map_sql as M
from terrafold.plans.data import CFG, SNAPS_SQL, TRACKS_SQL, asked, points, r6, terrain, tracks
from terrafold.plans.planner import TerrainMap
from terrafold.sources import pcd, scene, sinks
from terrafold.store import new_path, stored

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
V = CFG.voxel_size


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return put


def _voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.voxel_downsample(points(spark, sf_dir), V)


# voxels and scalars ------------------------------------------------------------


@query(M.upto("vox", "SELECT node_id, gx, gy, gz, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, n FROM vox"))
def voxel_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voxels(spark, sf_dir).select("node_id", "gx", "gy", "gz", *(r6(c, c) for c in "xyz"), "n")


@query(M.upto("pts", "SELECT floor(x / 0.1)::BIGINT AS gx, floor(y / 0.1)::BIGINT AS gy, floor(z / 0.1)::BIGINT AS gz, count(*) AS n FROM pts GROUP BY 1, 2, 3"))
def voxel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.voxel_cells(points(spark, sf_dir), 0.1).select("gx", "gy", "gz", "n")


@query("SELECT event_id, x, y, z FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'nan'::DOUBLE ELSE value END AS x, CASE WHEN event_id % 11 = 0 THEN 'inf'::DOUBLE ELSE value END AS y, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS z FROM events) WHERE isfinite(x) AND isfinite(y) AND isfinite(z)")
def finite_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    bad = lambda m, v: F.when(F.col("event_id") % m == 0, F.lit(v).cast("double")).otherwise(F.col("value"))
    return surface.finite(e.select("event_id", bad(7, float("nan")).alias("x"), bad(11, float("inf")).alias("y"), bad(13, None).alias("z")))


@query(M.upto("pts", "SELECT round(min(x), 6) AS min_x, round(max(x), 6) AS max_x, round(min(y), 6) AS min_y, round(max(y), 6) AS max_y, round(min(z), 6) AS min_z, round(max(z), 6) AS max_z, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y, round(avg(z), 6) AS mean_z, count(*) AS n FROM pts"))
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    agg = [F.round(f(c), 6).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    return points(spark, sf_dir).agg(*agg, F.count(F.lit(1)).alias("n"))


# neighbours --------------------------------------------------------------------


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("node_id"), *(F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")))


_VEC = "v AS (SELECT vec_id AS node_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"


@query(f"WITH {_VEC} SELECT node_id, neighbour, rank, round(d, 6) AS d FROM (SELECT a.node_id, b.node_id AS neighbour, {M.dist('a', 'b')} AS d, row_number() OVER (PARTITION BY a.node_id ORDER BY {M.dist('a', 'b')}, b.node_id) AS rank FROM v a, v b) WHERE rank <= 8")
def knn_join_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = stored(_vectors(spark, sf_dir), "vectors")
    near = spatial.knn_by_place(v, v, 8)
    return near.select(F.col("l_node_id").alias("node_id"), F.col("r_node_id").alias("neighbour"), F.col("rank").cast("long").alias("rank"), r6("d", "d"))


@query(M.upto("vox", f"SELECT node_id, neighbour, rank, round(d, 6) AS d FROM (SELECT a.node_id, b.node_id AS neighbour, {M.dist('a', 'b')} AS d, row_number() OVER (PARTITION BY a.node_id ORDER BY {M.dist('a', 'b')}, b.node_id) AS rank FROM vox a, vox b WHERE a.node_id <> b.node_id AND {M.dist('a', 'b')} < 1.1) WHERE rank <= 6"))
def knn_join_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = stored(_voxels(spark, sf_dir).select("node_id", "x", "y", "z"), "voxels")
    near = spatial.knn_join(v, v, 6, V, radius=1.1, keep=lambda: F.col("l_node_id") != F.col("r_node_id"))
    return near.select(F.col("l_node_id").alias("node_id"), F.col("r_node_id").alias("neighbour"), F.col("rank").cast("long").alias("rank"), r6("d", "d"))


@query(M.upto("vox", f"SELECT a.node_id, count(*) AS n, round(sum({M.dist('a', 'b')}), 6) AS total FROM vox a, vox b WHERE {M.dist('a', 'b')} < 0.9 GROUP BY 1"))
def radius_join_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = stored(_voxels(spark, sf_dir).select("node_id", "x", "y", "z"), "voxels")
    return spatial.radius_join(v, v, 0.9).groupBy(F.col("l_node_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("d"), 6).alias("total"))


@query(M.upto("vox", f"SELECT point_id, m.node_id AS node_id, round(m.d, 6) AS d FROM (SELECT point_id, min({{'d': {M.dist('a', 'b')}, 'node_id': b.node_id}}) AS m FROM asked a, vox b GROUP BY 1)", SNAPS_SQL))
def nearest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = spatial.nearest(asked(spark, sf_dir), stored(_voxels(spark, sf_dir).select("node_id", "x", "y", "z"), "voxels"), V, left_id="point_id")
    return near.select(F.col("l_point_id").alias("point_id"), F.col("r_node_id").alias("node_id"), r6("d", "d"))


# surface -----------------------------------------------------------------------


def _cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = stored(_voxels(spark, sf_dir).select("node_id", "x", "y", "z"), "voxels")
    return surface.covariances(surface.neighbourhoods(v, CFG.normal_k, 0.0, V))


_SIX = ("xx", "xy", "xz", "yy", "yz", "zz")


@query(M.upto("cov", "SELECT node_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _SIX) + " FROM cov"))
def covariance3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cov(spark, sf_dir).select("node_id", *(r6(c, c) for c in _SIX))


@query(M.upto("eig", "SELECT node_id, round(l3, 6) AS l3, round(l1, 6) AS l1 FROM eig"))
def eig3_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    six = [F.col(c) for c in _SIX]
    return _cov(spark, sf_dir).select("node_id", r6(g.smallest_eigenvalue(*six), "l3"), r6(g.other_eigenvalues(*six)[0], "l1"))


@query(M.upto("shape", "SELECT node_id, round(slope, 5) AS slope, round(roughness, 5) AS roughness FROM shape"))
def slope_roughness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.normals(_cov(spark, sf_dir)).select("node_id", F.round("slope", 5).alias("slope"), F.round("roughness", 5).alias("roughness"))


@query(M.upto("vox", f"""SELECT node_id, layer, round(bottom, 6) AS bottom, z - bottom <= 0.25 AS candidate FROM (SELECT *, min(z) OVER (PARTITION BY cx, cy, layer) AS bottom FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY cx, cy ORDER BY z, node_id ROWS UNBOUNDED PRECEDING)::BIGINT AS layer FROM (SELECT *, CASE WHEN below IS NULL OR z - below > {CFG.layer_gap} THEN 1 ELSE 0 END AS fresh FROM (
  SELECT *, lag(z) OVER (PARTITION BY cx, cy ORDER BY z, node_id) AS below FROM (SELECT node_id, z, floor(x / {V})::BIGINT AS cx, floor(y / {V})::BIGINT AS cy FROM vox)))))"""))
def layer_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.layer_bottoms(_voxels(spark, sf_dir), V, CFG.layer_gap, 0.25).select("node_id", "layer", r6("bottom", "bottom"), "candidate")


@query(M.upto("shape", "SELECT surface, count(*) AS n, round(avg(z), 6) AS mean_z FROM shape GROUP BY 1"))
def surface_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = stored(_voxels(spark, sf_dir), "voxels")
    full = v.join(surface.estimate_normals(v, CFG.normal_k, 0.0, V), "node_id").withColumn("surface", surface.is_surface(CFG))
    return full.groupBy("surface").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("z"), 6).alias("mean_z"))


@query(M.upto("ground", "SELECT node_id, round(clearance::DOUBLE, 5) AS clearance FROM ground WHERE clearance IS NOT NULL"))
def clearance_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain(spark, sf_dir).nodes.filter("clearance IS NOT NULL").select("node_id", F.round(F.col("clearance").cast("double"), 5).alias("clearance"))


@query(M.upto("ground", "SELECT node_id, round(cost::DOUBLE, 3) AS cost FROM ground"))
def inflation_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain(spark, sf_dir).nodes.select("node_id", F.round(F.col("cost").cast("double"), 3).alias("cost"))


@query(M.upto("ground", "SELECT node_id, lethal FROM ground"))
def lethal_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain(spark, sf_dir).nodes.select("node_id", "lethal")


@query(M.upto("ground", "SELECT count(*) AS nodes, count(*) FILTER (NOT lethal) AS free, count(*) FILTER (lethal) AS lethal, (SELECT count(*) FROM obst) AS obstacles, round(avg(CASE WHEN lethal THEN 0 ELSE 1 END), 6) AS free_ratio, round(min(z), 6) AS z_min, round(max(z), 6) AS z_max FROM ground"))
def map_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = terrain(spark, sf_dir)
    n = t.nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(~F.col("lethal")).alias("free"), F.count_if("lethal").alias("lethal"), F.round(F.avg((~F.col("lethal")).cast("int")), 6).alias("free_ratio"), F.round(F.min("z"), 6).alias("z_min"), F.round(F.max("z"), 6).alias("z_max"))
    return n.crossJoin(t.obstacles.agg(F.count(F.lit(1)).alias("obstacles")))  # one row by one row


@query(M.upto("ground", f"""SELECT node_id, CASE WHEN lethal THEN {g.LETHAL_RGB[0]} ELSE floor({{r}})::INT END AS r, CASE WHEN lethal THEN {g.LETHAL_RGB[1]} ELSE floor({{g}})::INT END AS g FROM (SELECT node_id, lethal, greatest(0, least(1, cost::DOUBLE / {CFG.lethal_cost})) AS t FROM ground)""".format(
    **{n: "CASE " + " ".join(f"WHEN t <= {b[0]} THEN {a[k]} + (t - {a[0]}) * {(b[k] - a[k]) / (b[0] - a[0])!r}::DOUBLE" for a, b in zip(g.RAMP, g.RAMP[1:])) + " END" for k, n in ((1, "r"), (2, "g"))})))
def cost_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = terrain(spark, sf_dir).nodes
    return n.select("node_id", g.cost_rgb(F.col("cost").cast("double"), F.col("lethal"), CFG.lethal_cost).alias("c")).select("node_id", "c.r", "c.g")


@query(M.upto("ground", "SELECT node_id, x, y, z FROM ground ORDER BY sha1(node_id::VARCHAR || ':0'), node_id LIMIT 200"))
def sample_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.sampled(terrain(spark, sf_dir).nodes.select("node_id", "x", "y", "z"), "node_id", 200)


# graph -------------------------------------------------------------------------


def _free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain(spark, sf_dir).nodes.filter("NOT lethal")


def _picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navgraph.candidate_edges(_free(spark, sf_dir), CFG)


@query(M.upto("pair", "SELECT src, count(*) AS n, round(sum(length), 6) AS total FROM pair GROUP BY 1"))
def edge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _free(spark, sf_dir).select("node_id", "x", "y", "z")
    pairs = spatial.radius_join(f, f, CFG.radius).filter(navgraph._allowed(CFG))
    return pairs.groupBy(F.col("l_node_id").alias("src")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("d"), 6).alias("total"))


@query(M.upto("pick", "SELECT src, dst, rank, round(length, 6) AS length FROM pick"))
def edge_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picked(spark, sf_dir).select("src", "dst", F.col("rank").cast("long").alias("rank"), r6("length", "length"))


@query(M.upto("cert", "SELECT src, dst, certified FROM cert"))
def edge_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = terrain(spark, sf_dir).nodes
    placed = stored(navgraph._placed(_picked(spark, sf_dir).withColumn("edge_id", F.monotonically_increasing_id()), nodes), "edges")
    own = ["node_id", "x", "y", "z"]
    return navgraph.certified(placed.filter(F.col("length") > 1.5 * V), nodes.filter("NOT lethal").select(*own), nodes.filter("lethal").select(*own), CFG).select("src", "dst", "certified")


@query(M.upto("kept", "SELECT src, dst, round(length, 6) AS length FROM kept"))
def edge_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = terrain(spark, sf_dir)
    return navgraph.safe_edges(stored(_picked(spark, sf_dir), "picked"), t.nodes, CFG).select("src", "dst", r6("length", "length"))


@query(M.upto("edge", "SELECT src, dst, round(w::DOUBLE, 5) AS w FROM edge"))
def edge_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain(spark, sf_dir).edges.select("src", "dst", F.round(F.col("w").cast("double"), 5).alias("w"))


@query(M.upto("edge", "SELECT (SELECT count(*) FROM edge) // 2 AS n_edges, (SELECT count(*) FROM wedge) AS n_edges_multiset"))
def edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = terrain(spark, sf_dir)
    kept = navgraph.safe_edges(stored(_picked(spark, sf_dir).drop("rank"), "picked"), t.nodes, CFG)
    two = navgraph.both_ways(navgraph.weighted(kept, t.nodes, CFG), dedupe=False).agg((F.count(F.lit(1)) / 2).cast("long").alias("n_edges_multiset"))
    return t.edges.agg((F.count(F.lit(1)) / 2).cast("long").alias("n_edges")).crossJoin(two)  # one row by one row


@query(M.upto("edge", "SELECT src, count(*) AS degree FROM edge GROUP BY 1"))
def edge_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navgraph.degrees(terrain(spark, sf_dir).edges)


@query(M.upto("edge", "SELECT src, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS nbrs FROM edge GROUP BY 1"))
def adjacency_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = navgraph.adjacency(terrain(spark, sf_dir).edges)
    return a.select("src", F.array_join(F.transform("nbrs", lambda x: x["dst"].cast("string")), ",").alias("nbrs"))


@query(M.upto("pick", "SELECT src, dst, round(length, 6) AS length FROM pick WHERE src % 3 <> 0 AND rank <= 4 UNION ALL SELECT src, dst, round(length, 6) FROM pick WHERE src % 3 = 0"))
def escalation_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = stored(_picked(spark, sf_dir), "picked")
    return navgraph.replaced(p.filter("rank <= 4").drop("rank"), p.filter("src % 3 = 0").drop("rank")).select("src", "dst", r6("length", "length"))


@query(M.upto("comp", "SELECT node_id, component FROM comp"))
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = terrain(spark, sf_dir)
    return navgraph.components(t.nodes, t.edges)


@query(M.upto("comp", "SELECT component, count(*) AS size FROM comp GROUP BY 1"))
def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navgraph.component_sizes(terrain(spark, sf_dir).nodes)


_BIP = "be AS MATERIALIZED (SELECT DISTINCT l_suppkey * 2 AS a, l_partkey * 2 + 1 AS b FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 48), bs AS (SELECT a AS n, b AS m FROM be UNION ALL SELECT b, a FROM be), bn AS (SELECT DISTINCT n FROM bs)"


@query(f"WITH RECURSIVE {_BIP}, c(n, k) USING KEY (n) AS (SELECT n, n FROM bn UNION SELECT bs.m, min(c.k) FROM c JOIN bs ON bs.n = c.n JOIN recurring.c r ON r.n = bs.m WHERE c.k < r.k GROUP BY bs.m) SELECT n AS node, k AS component FROM c")
def bipartite_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrafold.operators.components import connected

    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_returnflag = 'R' AND l_quantity > 48")
    a, b = F.col("l_suppkey") * 2, F.col("l_partkey") * 2 + 1
    return connected(stored(t.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "pairs")).select("node", "component")


# paths -------------------------------------------------------------------------

_SEED = "SELECT min(node_id) AS node_id FROM free WHERE node_id IN (SELECT src FROM edge)"


def _seed(t: TerrainMap) -> int:
    return t.edges.agg(F.min("src")).first()[0]


@query(M.upto("edge", "SELECT node, round(dist, 5) AS dist FROM d", M.sssp("d", _SEED)))
def sssp_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = terrain(spark, sf_dir)
    return paths.sssp(t.edges, t.edges.filter(F.col("src") == _seed(t)).select(F.lit(0).alias("source"), F.col("src").alias("node"))).select("node", F.round("dist", 5).alias("dist"))


@query(M.upto("edge", "SELECT node, round(dist, 5) AS dist FROM d WHERE dist <= 5", M.sssp("d", _SEED)))
def reachable_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = terrain(spark, sf_dir)
    return paths.reachable_set(t.edges, _seed(t), 5.0, t.graph).select("node", F.round("dist", 5).alias("dist"))


def _goals(spark: SparkSession, t: TerrainMap) -> DataFrame:
    """A query from the seed to every free node."""
    s = _seed(t)
    return t.nodes.filter("NOT lethal").repartition(8, "node_id").select(F.col("node_id").alias("query_id"), F.lit(s).alias("start_id"), F.col("node_id").alias("goal_id"))


_COST = M.upto("edge", "SELECT f.node_id AS query_id, d.dist IS NOT NULL AS success, round(d.dist, 4) AS cost FROM free f LEFT JOIN d ON d.node = f.node_id", M.sssp("d", _SEED))


def _costs(spark: SparkSession, sf_dir: str, **how: object) -> DataFrame:
    t = terrain(spark, sf_dir)
    got = paths.shortest_paths(t.nodes, t.edges, _goals(spark, t), graph=t.graph, **how)
    return got.select("query_id", "success", F.when(F.col("success"), F.round("cost", 4)).alias("cost"))


@query(_COST)
def astar_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _costs(spark, sf_dir)


@query(_COST)
def dijkstra_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _costs(spark, sf_dir, weight=0.0)


@query(_COST)
def bidirectional_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _costs(spark, sf_dir, two_sided=True)


@query(_COST)
def alt_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = terrain(spark, sf_dir)
    return _costs(spark, sf_dir, marks=paths.landmarks(t.edges, t.nodes, 3, t.graph))


@query(_COST)
def relaxation_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = terrain(spark, sf_dir)
    turned = _goals(spark, t).select("query_id", F.col("goal_id").alias("start_id"), F.col("start_id").alias("goal_id"))  # one goal: one relaxation
    got = paths.shortest_paths(t.nodes, t.edges, turned, backend="relaxation")
    return got.select("query_id", "success", F.when(F.col("success"), F.round("cost", 4)).alias("cost"))


@query(M.upto("comp", "SELECT query_id, false AS success, 0::BIGINT AS expanded FROM (SELECT node_id AS query_id, component FROM comp JOIN ground USING (node_id) WHERE lethal)"))
def disconnected_fail(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = terrain(spark, sf_dir)
    asked_ = t.nodes.filter("lethal").select(F.col("node_id").alias("query_id"), F.lit(_seed(t)).alias("start_id"), F.col("node_id").alias("goal_id"))
    return paths.shortest_paths(t.nodes, t.edges, asked_, graph=t.graph).select("query_id", "success", "expanded")


_BIG = "big AS (SELECT component FROM comp JOIN free USING (node_id) GROUP BY component ORDER BY count(*) DESC, component LIMIT 1), l0 AS (SELECT node_id FROM free JOIN comp USING (node_id) WHERE component = (SELECT component FROM big) ORDER BY x + y DESC, node_id LIMIT 1)"


@query(M.upto("comp", "SELECT 0 AS landmark_id, node AS node_id, round(dist::FLOAT::DOUBLE, 4) AS d FROM m0 UNION ALL SELECT 1, node, round(dist::FLOAT::DOUBLE, 4) FROM m1", _BIG, M.sssp("m0", "SELECT node_id FROM l0"), "l1 AS (SELECT node AS node_id FROM m0 ORDER BY dist::FLOAT DESC, node LIMIT 1)", M.sssp("m1", "SELECT node_id FROM l1")))
def alt_landmark_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = terrain(spark, sf_dir)
    return paths.landmarks(t.edges, t.nodes, 2, t.graph).select("landmark_id", "node_id", F.round(F.col("d").cast("double"), 4).alias("d"))


@query(M.upto("comp", "SELECT node AS node_id, round(abs(dist::FLOAT::DOUBLE - (SELECT dist::FLOAT::DOUBLE FROM m0 WHERE node = (SELECT min(node) FROM m0))), 4) AS h FROM m0", _BIG, M.sssp("m0", "SELECT node_id FROM l0")))
def alt_lower_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = terrain(spark, sf_dir)
    m = paths.landmarks(t.edges, t.nodes, 1, t.graph)
    return paths.landmark_bound(m, m.agg(F.min("node_id")).first()[0]).select("node_id", F.round("h", 4).alias("h"))


@query("WITH RECURSIVE w(leaf, node, step) AS (SELECT c_custkey, c_custkey, 0::BIGINT FROM customer UNION ALL SELECT leaf, node // 2, step + 1 FROM w WHERE node >= 2) SELECT leaf, node, step FROM w")
def parent_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("node"))
    tree = c.select("node", F.when(F.col("node") >= 2, F.floor(F.col("node") / 2)).otherwise(F.lit(-1)).cast("long").alias("parent"))
    return paths.parent_trace(tree, c.select(F.col("node").alias("leaf")))


# trajectories ------------------------------------------------------------------


def _t(select: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([TRACKS_SQL, *more]) + "\n" + select


_STEP = "st AS (SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w) + (z - lag(z) OVER w) * (z - lag(z) OVER w)) AS step, z - lag(z) OVER w AS dz FROM trk WINDOW w AS (PARTITION BY path_id ORDER BY seq))"
_ARC = "arc AS (SELECT *, sum(coalesce(step, 0)) OVER (PARTITION BY path_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM st)"


@query(_t("SELECT path_id, round(sum(coalesce(step, 0)), 6) AS length, round(sum(greatest(coalesce(dz, 0), 0)), 6) AS climb, count(*) AS n_poses FROM st GROUP BY 1", _STEP))
def path_length_climb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.metrics(tracks(spark, sf_dir)).select("path_id", r6("length", "length"), r6("climb", "climb"), "n_poses")


@query(_t("SELECT path_id, seq, round(s, 6) AS s FROM arc", _STEP, _ARC))
def arc_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.arc_length(tracks(spark, sf_dir)).select("path_id", "seq", r6("s", "s"))


_YAW = "yaw AS (SELECT path_id, seq, x, y, z, coalesce(ahead, lag(ahead) OVER (PARTITION BY path_id ORDER BY seq), 0) AS yaw FROM (SELECT *, atan2(lead(y) OVER w - y, lead(x) OVER w - x) AS ahead FROM trk WINDOW w AS (PARTITION BY path_id ORDER BY seq)))"


@query(_t("SELECT path_id, seq, round(yaw, 6) AS yaw FROM yaw", _YAW))
def yaw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.yaws(tracks(spark, sf_dir)).select("path_id", "seq", r6("yaw", "yaw"))


@query(_t("""SELECT path_id, i AS seq, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z FROM (
  SELECT path_id, i, x + (i * 0.5 - s) / (ns - s) * (nx - x) AS x, y + (i * 0.5 - s) / (ns - s) * (ny - y) AS y, z + (i * 0.5 - s) / (ns - s) * (nz - z) AS z
  FROM tg JOIN seg USING (path_id) WHERE i * 0.5 >= s AND i * 0.5 < ns AND i * 0.5 < total UNION ALL SELECT path_id, ceil(s / 0.5)::BIGINT, x, y, z FROM seg WHERE ns IS NULL)""", _STEP, _ARC,
    "seg AS MATERIALIZED (SELECT path_id, x, y, z, s, max(s) OVER (PARTITION BY path_id) AS total, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz, lead(s) OVER w AS ns FROM arc WINDOW w AS (PARTITION BY path_id ORDER BY seq))",
    "tg AS (SELECT path_id, unnest(range(0, ceil(t / 0.5)::BIGINT)) AS i FROM (SELECT path_id, max(s) AS t FROM arc GROUP BY 1))"))
def resample_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.resample(tracks(spark, sf_dir), 0.5).select("path_id", "seq", *(F.round(c, 5).alias(c) for c in "xyz"))


def _smooth_sql() -> tuple[str, ...]:
    out, before = ["s0 AS (SELECT path_id, seq, x, y, z, x AS ox, y AS oy, z AS oz FROM trk)"], "s0"
    for i in range(1, 4):
        new = ", ".join(f"CASE WHEN lag({c}) OVER w IS NULL OR lead({c}) OVER w IS NULL THEN {c} ELSE ({c} + 0.35::DOUBLE * (o{c} - {c})) + 0.35::DOUBLE * (lag({c}) OVER w + lead({c}) OVER w - 2 * ({c} + 0.35::DOUBLE * (o{c} - {c}))) END AS {c}" for c in "xyz")
        out.append(f"s{i} AS (SELECT path_id, seq, {new}, ox, oy, oz FROM {before} WINDOW w AS (PARTITION BY path_id ORDER BY seq))")
        before = f"s{i}"
    return tuple(out)


@query(_t("SELECT path_id, seq, round(x, 10) AS x, round(y, 10) AS y, round(z, 10) AS z FROM s3", *_smooth_sql()))
def smooth_stencil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.smooth(tracks(spark, sf_dir), 3, 0.35, 0.35).select("path_id", "seq", *(F.round(c, 10).alias(c) for c in "xyz"))  # exact to eight decimals, so nothing stands on a tie


@query(M.upto("node", f"SELECT point_id, round(sum(nz / (d + 1e-6::DOUBLE)) / sum(1 / (d + 1e-6::DOUBLE)), 6) AS z FROM (SELECT point_id, b.z AS nz, {M.dist('a', 'b')} AS d, row_number() OVER (PARTITION BY point_id ORDER BY {M.dist('a', 'b')}, b.node_id) AS rk FROM asked a, node b) WHERE rk <= 4 GROUP BY 1", SNAPS_SQL))
def idw_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = asked(spark, sf_dir).select(F.col("point_id").alias("path_id"), F.lit(0).cast("long").alias("seq"), "x", "y", "z")
    return tr.project(pts, terrain(spark, sf_dir).nodes, V).select(F.col("path_id").alias("point_id"), r6("z", "z"))


@query(M.upto("ground", f"SELECT point_id, m.node_id AS node_id, round(m.score, 5) AS score FROM (SELECT point_id, min({{'score': d + 0.01::DOUBLE * cost::DOUBLE, 'd': d, 'node_id': node_id}}) AS m FROM (SELECT point_id, b.node_id, cost, lethal, {M.dist('a', 'b')} AS d, row_number() OVER (PARTITION BY point_id ORDER BY {M.dist('a', 'b')}, b.node_id) AS rk FROM asked a, ground b WHERE {M.dist('a', 'b')} < {CFG.snap_radius}) WHERE NOT lethal AND rk <= 64 GROUP BY 1)", SNAPS_SQL))
def node_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.snap(asked(spark, sf_dir), terrain(spark, sf_dir).nodes, CFG.snap_radius).select("point_id", "node_id", F.round("score", 5).alias("score"))


@query(_t("SELECT path_id, seq, round(cos(yaw / 2), 6) AS qw, round(sin(yaw / 2), 6) AS qz FROM yaw", _YAW))
def quaternions(spark: SparkSession, sf_dir: str) -> DataFrame:
    poses = tr.yaws(tracks(spark, sf_dir)).select("path_id", "seq", "yaw", F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"))
    q = tr.quaternions(poses)
    sign = F.when((F.col("qw") < 0) | ((F.col("qw") < 1e-9) & (F.sign("qz") != F.sign(F.sin(F.col("yaw") / 2)))), -1.0).otherwise(1.0)
    return q.select("path_id", "seq", F.round(sign * F.col("qw"), 6).alias("qw"), F.round(sign * F.col("qz"), 6).alias("qz"))


_TILT = "n AS (SELECT event_id, (event_id % 628) / 100::DOUBLE - 3.14::DOUBLE AS yaw, (event_id * 37 % 199 - 99) / 100::DOUBLE AS nx, (event_id * 53 % 211 - 105) / 100::DOUBLE AS ny, (event_id * 71 % 223 - 111) / 100::DOUBLE AS nz FROM events), u AS (SELECT event_id, yaw, nx / s AS nx, ny / s AS ny, nz / s AS nz FROM (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS s FROM n) WHERE s > 0.01), f AS (SELECT *, cos(yaw) - al * nx AS fx, sin(yaw) - al * ny AS fy, -al * nz AS fz FROM (SELECT *, cos(yaw) * nx + sin(yaw) * ny AS al FROM u))"


@query(f"WITH {_TILT} SELECT event_id, " + ", ".join(f"round({c}, 5) + 0.0 AS {n}" for c, n in (("nx", "ux"), ("ny", "uy"), ("nz", "uz"), ("fx / s", "fx"), ("fy / s", "fy"), ("fz / s", "fz"))) + " FROM (SELECT *, sqrt(fx * fx + fy * fy + fz * fz) AS s FROM f) WHERE s > 0.01")
def quaternions_tilted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The up and front axes that headings on tilted normals turn to, from the quaternions; SQL has them from the normals."""
    i = F.col("event_id")
    n = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", ((i % 628) / 100.0 - 3.14).alias("yaw"), ((i * 37 % 199 - 99) / 100.0).alias("nx"), ((i * 53 % 211 - 105) / 100.0).alias("ny"), ((i * 71 % 223 - 111) / 100.0).alias("nz"))
    size = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    along = (F.cos("yaw") * F.col("nx") + F.sin("yaw") * F.col("ny")) / size  # of the front on the normal
    q = tr.quaternions(n.filter(size > 0.01).filter(1 - along**2 > 0.0001))
    x, y, z, w = (F.col(f"q{c}") for c in "xyzw")
    axes = {"ux": 2 * (x * z + w * y), "uy": 2 * (y * z - w * x), "uz": 1 - 2 * (x * x + y * y), "fx": 1 - 2 * (y * y + z * z), "fy": 2 * (x * y + w * z), "fz": 2 * (x * z - w * y)}
    return q.select("event_id", *((F.round(c, 5) + 0.0).alias(n) for n, c in axes.items()))


@query(_t("SELECT path_id, seq, printf('%.6f,%.6f,%.6f,%.6f', x, y, z, yaw) AS line FROM yaw", _YAW))
def csv_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.csv_lines(tr.yaws(tracks(spark, sf_dir)).withColumnRenamed("path_id", "query_id")).withColumnRenamed("query_id", "path_id")


@query(_t("SELECT path_id, count(*) AS n, round(sum(round_even(x, 4)), 4) AS sx, round(sum(round_even(yaw, 4)), 4) AS syaw FROM yaw GROUP BY 1", _YAW))
def json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    poses = tr.yaws(tracks(spark, sf_dir)).withColumnRenamed("path_id", "query_id")
    summary = tr.metrics(tracks(spark, sf_dir)).select(F.col("path_id").alias("query_id"), F.lit(True).alias("success"), F.lit("ok").alias("message"), "length", "climb", F.lit(float("inf")).alias("cost"), F.lit(0).cast("long").alias("expanded"))
    got = sinks.payloads(poses, summary).select("query_id", F.from_json("payload", "path struct<x:array<double>,yaw:array<double>>").alias("p"))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, v: a + v), 4)
    return got.select(F.col("query_id").alias("path_id"), F.size("p.path.x").cast("long").alias("n"), total("p.path.x").alias("sx"), total("p.path.yaw").alias("syaw"))


@query("SELECT event_id, round(CASE WHEN value <= 10 THEN 0 WHEN value <= 50 THEN (value - 10) * 0.025::DOUBLE WHEN value <= 100 THEN 1 + (value - 50) * 0.04::DOUBLE ELSE 3 END, 6) AS y FROM events")
def interpolate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", r6(g.interpolate(F.col("value"), [(10.0, 0.0), (50.0, 1.0), (100.0, 3.0)]), "y"))


@query(M.upto("vox", "SELECT node_id, base64(encode(node_id::VARCHAR)) AS b64, sha1(gx::VARCHAR || ',' || gy::VARCHAR || ',' || gz::VARCHAR) AS fingerprint FROM vox"))
def encode_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voxels(spark, sf_dir).select("node_id", F.base64(F.col("node_id").cast("string").cast("binary")).alias("b64"), F.sha1(F.concat_ws(",", "gx", "gy", "gz")).alias("fingerprint"))


# whole plans, files, streams ---------------------------------------------------


def _routes(t: TerrainMap) -> DataFrame:
    """Four queries between corners of the largest component's free nodes."""
    big = t.nodes.filter("NOT lethal").groupBy("component").count().orderBy(F.desc("count"), "component").first()["component"]
    n = t.nodes.filter((F.col("component") == big) & ~F.col("lethal"))
    p = F.struct("x", "y", "z")
    ends = n.agg(*(F.min_by(p, F.struct((F.col("x") * a + F.col("y") * b).alias("k"), F.col("node_id"))).alias(f"c{i}") for i, (a, b) in enumerate(((1, 1), (-1, -1), (1, -1), (-1, 1))))).first()
    rows = [(0, ends["c0"], ends["c1"]), (1, ends["c2"], ends["c3"]), (2, ends["c0"], ends["c2"]), (3, ends["c0"], (500.0, 500.0, 0.0))]
    s = "struct<x:double,y:double,z:double>"
    return t.nodes.sparkSession.createDataFrame([(q, tuple(a), tuple(b)) for q, a, b in rows], f"query_id long, start {s}, goal {s}")


_CORNERS = ", ".join(f"arg_min({{'x': x, 'y': y, 'z': z}}, {{'k': x * {a} + y * {b}, 'i': node_id}}) AS c{i}" for i, (a, b) in enumerate(((1, 1), (-1, -1), (1, -1), (-1, 1))))
_ENDS = " UNION ALL ".join(f"SELECT {i} AS point_id, c{i}.x AS x, c{i}.y AS y, c{i}.z AS z FROM corner" for i in range(4))
_SNAPPED = f"snapped AS MATERIALIZED (SELECT point_id, min({{'score': d + 0.01::DOUBLE * cost::DOUBLE, 'd': d, 'node_id': node_id}}).node_id AS node_id FROM (SELECT point_id, b.node_id, cost, lethal, {M.dist('a', 'b')} AS d, row_number() OVER (PARTITION BY point_id ORDER BY {M.dist('a', 'b')}, b.node_id) AS rk FROM ends_ a, ground b WHERE {M.dist('a', 'b')} < {CFG.snap_radius}) WHERE NOT lethal AND rk <= 64 GROUP BY 1)"
_END = lambda i: f"SELECT node_id FROM snapped WHERE point_id = {i}"
_LEG = lambda q, m, i: f"SELECT {q} AS query_id, count(*) > 0 AS success, round(max(dist), 4) AS cost FROM {m} WHERE node = ({_END(i)})"


def _route_sql(legs: list[str], *seeds: int) -> str:
    """``legs`` over the distances m<i> from each corner i of ``seeds``."""
    corner = f"corner AS (SELECT {_CORNERS} FROM free JOIN comp USING (node_id) WHERE component = (SELECT component FROM big))"
    return M.upto("comp", " UNION ALL ".join(legs), _BIG, corner, f"ends_ AS MATERIALIZED ({_ENDS})", _SNAPPED, *(M.sssp(f"m{i}", _END(i)) for i in seeds))


def _told(summary: DataFrame) -> DataFrame:
    return summary.select(F.col("query_id").cast("int").alias("query_id"), "success", F.when(F.col("success"), F.round("cost", 4)).alias("cost"))


_ROUTES_SQL = _route_sql([_LEG(0, "m0", 1), _LEG(1, "m2", 3), _LEG(2, "m0", 2), "SELECT 3, false, NULL"], 0, 2)


@query(_ROUTES_SQL)
def plan_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What whole plans cost: snapping and search of the routes that the other plan queries shape."""
    t = terrain(spark, sf_dir)
    return _told(t.make_plans(_routes(t))[1])


@query()
def shortcut_farthest(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = terrain(spark, sf_dir)
    got = t.search(t.snapped(_routes(t))).filter("success").select(F.col("query_id").alias("path_id"), F.posexplode("path").alias("seq", "node_id"))
    raw = stored(got.join(t.nodes.select("node_id", "x", "y", "z"), "node_id").select("path_id", F.col("seq").cast("long").alias("seq"), "x", "y", "z"), "raw")
    return tr.shortcut(raw, tr.feasible_jumps(raw, t.nodes, CFG))


@query()
def plan_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = terrain(spark, sf_dir)
    return t.make_plans(_routes(t))[1].drop("planning_time")


@query()
def plan_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = terrain(spark, sf_dir)
    return tr.quaternions(t.make_plans(_routes(t))[0])


@query(_route_sql([_LEG(0, "m1", 3), _LEG(1, "m3", 2)], 1, 3))
def plan_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = terrain(spark, sf_dir)
    legs = _routes(t).filter("query_id < 3").select(F.lit(0).alias("route_id"), F.col("query_id").alias("seq"), "goal.*")
    return _told(t.plan_through(legs)[1])


@query(M.upto("pts", "SELECT count(*) AS n, round(sum(x::FLOAT::DOUBLE), 3) AS sx, round(sum(y::FLOAT::DOUBLE), 3) AS sy, round(sum(z::FLOAT::DOUBLE), 3) AS sz FROM pts"))
def pcd_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tempfile.mkdtemp(prefix="terrafold-pcd-") if spark.sparkContext.master.startswith("local[") else new_path(spark, "pcd").removeprefix("file:")
    pcd.write(points(spark, sf_dir).select(*(F.col(c).cast("float").alias(c) for c in "xyz")), folder)
    back = pcd.read(spark, folder)
    return back.agg(F.count(F.lit(1)).alias("n"), *(F.round(F.sum(F.col(c).cast("double")), 3).alias(f"s{c}") for c in "xyz"))


@query(M.upto("edge", "SELECT (SELECT count(*) FROM ground) AS nodes, (SELECT count(*) FROM edge) AS edges, (SELECT count(*) FROM obst) AS obstacles"))
def cache_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, folder = terrain(spark, sf_dir), new_path(spark, "map")
    t.save(folder)
    back = TerrainMap.load(spark, folder, CFG)
    one = [getattr(back, p).agg(F.count(F.lit(1)).alias(p)) for p in ("nodes", "edges", "obstacles")]
    return one[0].crossJoin(one[1]).crossJoin(one[2])  # one row each


@query()
def demo_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.voxel_cells(scene.scene(spark), 0.5)


@query("SELECT floor(user_id / 10)::BIGINT AS gx, floor(value / 10)::BIGINT AS gy, floor(event_id / 1000)::BIGINT AS gz, count(*) AS n, round(sum(value), 4) AS sy FROM events GROUP BY 1, 2, 3")
def streaming_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrafold.streaming.streams import voxel_stream

    src = f"{sf_dir}/events.parquet"
    kind = spark.read.parquet(src).schema
    rows = spark.readStream.schema(kind).parquet(f"{src}*").select((F.col("user_id") / 10.0).alias("x"), (F.col("value") / 10.0).alias("y"), (F.col("event_id") / 1000.0).alias("z"), "value")
    out = voxel_stream(rows.select("x", "y", "z"), 1.0)
    return _last_of_each(out, ["gx", "gy", "gz"]).select("gx", "gy", "gz", "n", F.round(F.col("sy") * 10, 4).alias("sy"))


def _last_of_each(stream: DataFrame, key: list[str]) -> DataFrame:
    """A stream's aggregate run over all that is there: each batch's changed rows go to Parquet, the last of each key counts."""
    spark, folder = stream.sparkSession, new_path(stream.sparkSession, "stream")
    q = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/part={n}")).option("checkpointLocation", new_path(spark, "offsets")).start()
    q.processAllAvailable()
    q.stop()
    rest = [c for c in stream.columns if c not in key]
    got = spark.read.parquet(folder).groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return got.select(*key, "last.*")


@query("SELECT epoch(date_trunc('day', ts))::BIGINT AS day, floor(user_id / 10)::BIGINT AS gx, floor(value / 10)::BIGINT AS gy, floor(event_id / 1000)::BIGINT AS gz, count(*) AS n FROM events GROUP BY 1, 2, 3, 4")
def streaming_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels by event-time days; the watermark is wide enough for the whole table, so nothing counts as late."""
    from terrafold.streaming.streams import windowed_voxels

    src = f"{sf_dir}/events.parquet"
    rows = spark.readStream.schema(spark.read.parquet(src).schema).parquet(f"{src}*")
    utc = F.expr("cast(convert_timezone('UTC', current_timezone(), ts) AS timestamp)").alias("ts")  # the table's times have no zone
    pts = rows.select(utc, (F.col("user_id") / 10.0).alias("x"), (F.col("value") / 10.0).alias("y"), (F.col("event_id") / 1000.0).alias("z"))
    got = _last_of_each(windowed_voxels(pts, 1.0, "1 day", "10000 days"), ["w", "gx", "gy", "gz"])
    return got.select(F.unix_timestamp("w.start").alias("day"), "gx", "gy", "gz", "n")


@query(_ROUTES_SQL)
def streaming_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrafold.streaming.streams import serve_goals

    t = terrain(spark, sf_dir)
    folder, done = new_path(spark, "goals"), new_path(spark, "answers")
    routes = _routes(t)
    routes.write.parquet(folder)
    q = serve_goals(spark.readStream.schema(routes.schema).parquet(folder), t, lambda path, summary, n: summary.drop("planning_time").write.parquet(f"{done}/batch={n}"), new_path(spark, "offsets"))
    q.processAllAvailable()
    q.stop()
    return _told(spark.read.parquet(done))


@query(M.upto("edge", "SELECT lethal, count(*) AS nodes, count(dist) AS reached, round(max(dist), 4) AS farthest FROM ground LEFT JOIN d ON d.node = ground.node_id GROUP BY lethal", M.sssp("d", _SEED)))
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points to voxels to a graph to distances: what can be reached from the first node, by component."""
    t = terrain(spark, sf_dir)
    d = paths.reachable_set(t.edges, _seed(t), graph=t.graph)
    return t.nodes.join(d.withColumnRenamed("node", "node_id"), "node_id", "left").groupBy("lethal").agg(F.count(F.lit(1)).alias("nodes"), F.count("dist").alias("reached"), F.round(F.max("dist"), 4).alias("farthest"))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


__all__ = ["flagship", "oracle_sql", "queries"]
