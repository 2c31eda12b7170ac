"""SQL of the shared map: a chain of common table expressions, each as simple as its meaning."""

from __future__ import annotations

import math

from terrafold.plans.data import CFG, POINTS_SQL, SNAPS_SQL, TRACKS_SQL

V = CFG.voxel_size
TAN = repr(CFG.tan_slope)
SLOPE = repr(math.radians(CFG.max_slope_deg))


def dist(a: str, b: str, axes: str = "xyz") -> str:
    return "sqrt(" + " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in axes) + ")"


VOX = f"""vox AS MATERIALIZED (SELECT row_number() OVER (ORDER BY gx, gy, gz) - 1 AS node_id, * FROM (
  SELECT floor(x / {V})::BIGINT AS gx, floor(y / {V})::BIGINT AS gy, floor(z / {V})::BIGINT AS gz,
         avg(x)::FLOAT::DOUBLE AS x, avg(y)::FLOAT::DOUBLE AS y, avg(z)::FLOAT::DOUBLE AS z, count(*) AS n FROM pts GROUP BY 1, 2, 3))"""
HOOD = f"""hood AS MATERIALIZED (SELECT * FROM (SELECT a.node_id, b.node_id AS nb, b.x, b.y, b.z, {dist("a", "b")} AS d,
  row_number() OVER (PARTITION BY a.node_id ORDER BY {dist("a", "b")}, b.node_id) AS rk FROM vox a, vox b) WHERE rk <= {CFG.normal_k})"""
COV = """cov AS MATERIALIZED (SELECT node_id, sum(x * x) / (count(*) - 1) AS xx, sum(x * y) / (count(*) - 1) AS xy, sum(x * z) / (count(*) - 1) AS xz,
  sum(y * y) / (count(*) - 1) AS yy, sum(y * z) / (count(*) - 1) AS yz, sum(z * z) / (count(*) - 1) AS zz
  FROM (SELECT node_id, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, z - avg(z) OVER w AS z FROM hood WINDOW w AS (PARTITION BY node_id)) GROUP BY node_id)"""
EIG = """eig AS MATERIALIZED (SELECT *, q + 2 * p * cos(phi + 2 * pi() / 3) AS l3, q + 2 * p * cos(phi) AS l1 FROM (SELECT *, acos(greatest(-1, least(1, det / 2))) / 3 AS phi FROM (
  SELECT *, (xx - q) / p * ((yy - q) / p * ((zz - q) / p) - yz / p * (yz / p)) - xy / p * (xy / p * ((zz - q) / p) - yz / p * (xz / p)) + xz / p * (xy / p * (yz / p) - (yy - q) / p * (xz / p)) AS det
  FROM (SELECT *, sqrt(greatest(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6, 1e-300::DOUBLE)) AS p FROM (SELECT *, (xx + yy + zz) / 3 AS q FROM cov)))))"""


def _nrm() -> str:
    m = (("xx", "xy", "xz"), ("xy", "yy", "yz"), ("xz", "yz", "zz"))
    at = lambda i, j, v: f"({m[i][j]} - {v})" if i == j else m[i][j]
    cols = ", ".join(f"{' + '.join(f'{at(i, k, "l1")} * {at(k, j, "l2")}' for k in range(3))} AS c{i}{j}" for i in range(3) for j in range(3))
    sizes = ", ".join(f"sqrt(c0{j} * c0{j} + c1{j} * c1{j} + c2{j} * c2{j}) AS s{j}" for j in range(3))
    pick = ", ".join(f"CASE WHEN s0 = b THEN c{i}0 WHEN s1 = b THEN c{i}1 ELSE c{i}2 END / b AS v{i}" for i in range(3))
    return f"""nrm AS MATERIALIZED (SELECT node_id, CASE WHEN b < 1e-12 THEN 0 ELSE up * v0 END AS nx, CASE WHEN b < 1e-12 THEN 0 ELSE up * v1 END AS ny,
  CASE WHEN b < 1e-12 THEN 1 ELSE up * v2 END AS nz, sqrt(greatest(l3, 0)) AS roughness FROM (SELECT *, CASE WHEN v2 < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS up FROM (
  SELECT *, {pick} FROM (SELECT *, greatest(s0, s1, s2) AS b FROM (SELECT *, {sizes} FROM (SELECT node_id, l3, {cols} FROM (SELECT *, 3 * q - l1 - l3 AS l2 FROM eig)))))))"""


NRM = _nrm()
SHAPE = f"""shape AS MATERIALIZED (SELECT vox.*, nx, ny, nz, acos(least(abs(nz), 1)) AS slope, roughness, (acos(least(abs(nz), 1)) <= {SLOPE} AND roughness <= {CFG.max_roughness}) AS surface FROM vox JOIN nrm USING (node_id))"""
NODE = "node AS MATERIALIZED (SELECT row_number() OVER (ORDER BY node_id) - 1 AS node_id, x, y, z, nx, ny, nz, slope, roughness FROM shape WHERE surface)"
OBST = "obst AS MATERIALIZED (SELECT node_id AS obst_id, x, y, z FROM shape WHERE NOT surface)"


def _band(name: str, other: str, radius: float) -> str:
    d = dist("a", "b", "xy")
    return f"""{name} AS MATERIALIZED (SELECT node_id, m.d AS d, m.dz AS dz FROM (SELECT node_id, min({{'d': d, 'dz': dz}}) AS m FROM (
  SELECT a.node_id, {d} AS d, (b.x - a.x) * a.nx + (b.y - a.y) * a.ny + (b.z - a.z) * a.nz AS dz FROM node a, {other} b WHERE {d} < {radius})
  WHERE dz > {CFG.max_step} AND dz < {CFG.robot_height} GROUP BY node_id))"""


ROOF, WALL = _band("roof", "vox", CFG.robot_radius), _band("wall", "obst", CFG.inflation_radius)
GROUND = f"""ground AS MATERIALIZED (SELECT node_id, x, y, z, nx::FLOAT AS nx, ny::FLOAT AS ny, nz::FLOAT AS nz, slope::FLOAT AS slope, roughness::FLOAT AS roughness, clearance::FLOAT AS clearance, lethal,
  (CASE WHEN lethal THEN {CFG.lethal_cost} WHEN gap <= {CFG.inflation_radius} THEN {CFG.lethal_cost - 1}::DOUBLE * exp(-{CFG.cost_scaling_factor}::DOUBLE * greatest(gap - {CFG.robot_radius}::DOUBLE, 0)) ELSE 0 END)::FLOAT AS cost
  FROM (SELECT node.*, roof.dz AS clearance, wall.d AS gap, (roof.dz IS NOT NULL OR coalesce(wall.d <= {CFG.robot_radius}, false)) AS lethal FROM node LEFT JOIN roof USING (node_id) LEFT JOIN wall USING (node_id)))"""
FREE = "free AS MATERIALIZED (SELECT * FROM ground WHERE NOT lethal)"
PAIR = f"""pair AS MATERIALIZED (SELECT * FROM (SELECT a.node_id AS src, b.node_id AS dst, {dist("a", "b")} AS length, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS dxy, abs(b.z - a.z) AS dz FROM free a, free b WHERE a.node_id <> b.node_id)
  WHERE length < {CFG.radius} AND length > 1e-9 AND dz <= greatest(dxy * {TAN}::DOUBLE, {CFG.max_step}))"""
PICK = f"pick AS MATERIALIZED (SELECT src, dst, length, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY length, dst) AS rank FROM pair) WHERE rank <= {CFG.max_neighbors})"
ENDS = """ends AS MATERIALIZED (SELECT src, dst, length, a.x AS px, a.y AS py, a.z AS pz, b.x AS qx, b.y AS qy, b.z AS qz FROM pick JOIN ground a ON a.node_id = src JOIN ground b ON b.node_id = dst)"""
MID = f"""mid AS MATERIALIZED (SELECT src, dst, length, (px + qx) / 2 AS x, (py + qy) / 2 AS y, (pz + qz) / 2 AS z FROM ends WHERE length > {1.5 * V})"""
CERT = f"""cert AS MATERIALIZED (SELECT mid.src, mid.dst, mid.length, coalesce(df + length / 2 <= {CFG.support} AND (dl IS NULL OR dl - df >= length), false) AS certified FROM mid
  LEFT JOIN (SELECT src, dst, min({dist("mid", "f")}) AS df FROM mid, free f GROUP BY src, dst) USING (src, dst)
  LEFT JOIN (SELECT src, dst, min({dist("mid", "t")}) AS dl FROM mid, (SELECT * FROM ground WHERE lethal) t GROUP BY src, dst) USING (src, dst))"""
SAMP = f"""par AS MATERIALIZED (SELECT least(greatest(ceil(m / {0.25 * V}), 2), 512)::INT AS n, m / (least(greatest(ceil(m / {0.25 * V}), 2), 512)::INT + 1) AS margin FROM (SELECT max(length) AS m FROM cert WHERE NOT certified)),
samp AS MATERIALIZED (SELECT src, dst, i, px + i / (n + 1)::DOUBLE * (qx - px) AS x, py + i / (n + 1)::DOUBLE * (qy - py) AS y, pz + i / (n + 1)::DOUBLE * (qz - pz) AS z
  FROM (SELECT e.*, n, unnest(range(1, n + 1)) AS i FROM ends e JOIN cert USING (src, dst), par WHERE NOT certified)),
near AS MATERIALIZED (SELECT s.src, s.dst, s.i, min(CASE WHEN NOT g.lethal THEN {dist("s", "g")} END) AS df, min(CASE WHEN g.lethal THEN {dist("s", "g")} END) AS dl FROM samp s JOIN ground g ON abs(s.x - g.x) < 3 AND abs(s.y - g.y) < 3 GROUP BY s.src, s.dst, s.i),
sure AS MATERIALIZED (SELECT src, dst FROM near, par GROUP BY src, dst HAVING bool_and(coalesce(df <= {CFG.support}, false) AND (dl IS NULL OR dl >= df + margin)))"""
KEPT = f"""kept AS MATERIALIZED (SELECT src, dst, length FROM pick WHERE length <= {1.5 * V} UNION ALL SELECT src, dst, length FROM cert WHERE certified UNION ALL SELECT pick.src, pick.dst, length FROM pick JOIN sure USING (src, dst))"""
EDGE = f"""wedge AS MATERIALIZED (SELECT src, dst, length, (length * (1.0::DOUBLE + {0.5 * CFG.cost_weight}::DOUBLE * (a.cost::DOUBLE + b.cost::DOUBLE)))::FLOAT AS w FROM kept JOIN ground a ON a.node_id = src JOIN ground b ON b.node_id = dst),
edge AS MATERIALIZED (SELECT src, dst, min(length) AS length, min(w) AS w FROM (SELECT src, dst, length, w FROM wedge UNION ALL SELECT dst, src, length, w FROM wedge) GROUP BY src, dst)"""
COMP = """comp(node_id, component) USING KEY (node_id) AS (SELECT node_id, node_id FROM ground UNION SELECT e.dst, min(comp.component) FROM comp JOIN edge e ON e.src = comp.node_id JOIN recurring.comp r ON r.node_id = e.dst WHERE comp.component < r.component GROUP BY e.dst)"""


def sssp(name: str, seed: str) -> str:
    return f"""{name}(node, dist) USING KEY (node) AS (SELECT node_id, 0.0::DOUBLE FROM ({seed}) UNION SELECT e.dst, min({name}.dist + e.w::DOUBLE) FROM {name} JOIN edge e ON e.src = {name}.node
  LEFT JOIN recurring.{name} r ON r.node = e.dst WHERE r.dist IS NULL OR {name}.dist + e.w::DOUBLE < r.dist GROUP BY e.dst)"""


CHAIN = [("pts", POINTS_SQL), ("vox", VOX), ("hood", HOOD), ("cov", COV), ("eig", EIG), ("nrm", NRM), ("shape", SHAPE), ("node", NODE), ("obst", OBST), ("roof", ROOF), ("wall", WALL), ("ground", GROUND),
         ("free", FREE), ("pair", PAIR), ("pick", PICK), ("ends", ENDS), ("mid", MID), ("cert", CERT), ("samp", SAMP), ("kept", KEPT), ("edge", EDGE), ("comp", COMP)]


def upto(last: str, select: str, *more: str) -> str:
    """``select`` over the chain up to ``last`` and further expressions."""
    names = [n for n, _ in CHAIN]
    parts = [sql for _, sql in CHAIN[: names.index(last) + 1]] if last else []
    return "WITH RECURSIVE " + ",\n".join([*parts, *more]) + "\n" + select


__all__ = ["CHAIN", "SNAPS_SQL", "TRACKS_SQL", "dist", "sssp", "upto"]
