"""A two-storey scene as a DataFrame: floors, walls, a ramp with rails, a table, pillars and low walls.

Each surface is a row of parameters; its samples come from a range and hashes of their number, so the cloud
is the same on any cluster.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The geometry in metres.
RAMP = (8.0, 16.0, 9.0, 13.0)
UPPER = 3.0
PLANES = (("floor", 0, 24, 0, 14, 0.0), ("upper", 16, 24, 6, 14, UPPER), ("table", 1, 3, 10, 12, 0.75))
WALLS = (
    (0, 0, 24, 0, 0.0, 4.2), (0, 14, 24, 14, 0.0, 4.2), (0, 0, 0, 14, 0.0, 4.2), (24, 0, 24, 14, 0.0, 4.2),
    (5, 0, 5, 6, 0.0, 2.6), (5, 7.6, 5, 14, 0.0, 2.6), (16, 6, 16, 9, UPPER, UPPER + 1), (16, 13, 16, 14, UPPER, UPPER + 1),
    (16, 6, 24, 6, UPPER, UPPER + 1), (18, 7, 18, 12, 0.0, 0.9), (18, 12, 22, 12, 0.0, 0.9),
)
PILLARS = ((7.0, 3.0, 0.35, 0.0, 2.6), (13.0, 5.0, 0.35, 0.0, 2.6), (20.0, 2.5, 0.35, 0.0, 2.6), (20.0, 10.0, 0.3, UPPER, UPPER + 1.2))
LEGS = ((1.1, 10.1), (2.9, 10.1), (1.1, 11.9), (2.9, 11.9))
NOISE = 0.005


def ramp_height(x: Column) -> Column:
    return (x - RAMP[0]) * (UPPER / (RAMP[1] - RAMP[0]))


def _unit(i: Column, part: int, which: int, seed: int) -> Column:
    """Evenly spread over [0, 1), decided by sample, surface and seed."""
    return F.pmod(F.xxhash64(i, F.lit(part), F.lit(which), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def _bell(i: Column, part: int, which: int, seed: int) -> Column:
    return NOISE * F.sqrt(-2 * F.log(1 - _unit(i, part, which, seed))) * F.cos(2 * math.pi * _unit(i, part, which + 50, seed))


def scene(spark: SparkSession, seed: int = 7, density: float = 45.0) -> DataFrame:
    """point_id, x, y, z (floats): about 36,600 points at the default density."""
    parts: list[DataFrame] = []

    def add(n: int, make, keep: Column | None = None) -> None:  # noqa: ANN001
        k = len(parts)
        i = F.col("id")
        x, y, z = make(lambda w: _unit(i, k, w, seed), lambda w: _bell(i, k, w, seed))
        df = spark.range(n).select(x.alias("x"), y.alias("y"), z.alias("z"))
        parts.append(df if keep is None else df.filter(keep))

    ramp = F.col("x").between(RAMP[0], RAMP[1]) & F.col("y").between(RAMP[2], RAMP[3])
    for name, x0, x1, y0, y1, h in PLANES:
        add(max(int((x1 - x0) * (y1 - y0) * density), 4), lambda u, b, a=(x0, x1, y0, y1, h): (a[0] + u(0) * (a[1] - a[0]), a[2] + u(1) * (a[3] - a[2]), a[4] + b(2)), ~ramp if name == "floor" else None)
    r = RAMP
    add(max(int((r[1] - r[0]) * (r[3] - r[2]) * density), 4), lambda u, b: (r[0] + u(0) * (r[1] - r[0]), r[2] + u(1) * (r[3] - r[2]), ramp_height(r[0] + u(0) * (r[1] - r[0])) + b(2)))
    for x0, y0, x1, y1, lo, hi in WALLS:
        n = max(int(math.hypot(x1 - x0, y1 - y0) * max(hi - lo, 0.05) * density), 8)
        add(n, lambda u, b, a=(x0, y0, x1, y1, lo, hi): (a[0] + u(0) * (a[2] - a[0]) + b(2), a[1] + u(0) * (a[3] - a[1]) + b(3), a[4] + u(1) * (a[5] - a[4])))
    for y in (r[2], r[3]):
        add(max(int((r[1] - r[0]) * density), 8), lambda u, b, y=y: (r[0] + u(0) * (r[1] - r[0]) + b(2), y + b(3), ramp_height(r[0] + u(0) * (r[1] - r[0])) + u(1)))
    round_ = [(*p, density) for p in PILLARS] + [(cx, cy, 0.05, 0.0, 0.75, 3 * density) for cx, cy in LEGS]
    for cx, cy, rad, lo, hi, dens in round_:
        n = max(int(2 * math.pi * rad * (hi - lo) * dens), 12)
        add(n, lambda u, b, a=(cx, cy, rad, lo, hi): (a[0] + a[2] * F.cos(2 * math.pi * u(0)), a[1] + a[2] * F.sin(2 * math.pi * u(0)), a[3] + u(1) * (a[4] - a[3])))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select(F.monotonically_increasing_id().alias("point_id"), *(F.col(c).cast("float").alias(c) for c in "xyz"))
