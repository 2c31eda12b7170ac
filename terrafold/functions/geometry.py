"""Geometry as Column expressions; none leaves the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(float(size))).cast("long")


def vec(prefix: str = "", names: str = "xyz") -> Vec:
    return tuple(F.col(prefix + n) for n in names)  # type: ignore[return-value]


def minus(a: Vec, b: Vec) -> Vec:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def norm2(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def distance(a: Vec, b: Vec) -> Column:
    return norm(minus(a, b))


def smallest_eigenvalue(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column) -> Column:
    """Of a symmetric 3 x 3 matrix, by the trigonometric solution of its characteristic cubic."""
    q = (xx + yy + zz) / 3
    p2 = (xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)
    p = F.sqrt(F.greatest(p2 / 6, F.lit(1e-300)))
    a, b, c = (xx - q) / p, (yy - q) / p, (zz - q) / p
    d, e, f = xy / p, xz / p, yz / p
    half = (a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / 2
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half))) / 3
    return q + 2 * p * F.cos(phi + F.lit(2 * math.pi / 3))


def other_eigenvalues(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column) -> tuple[Column, Column]:
    """The largest and the middle one."""
    q = (xx + yy + zz) / 3
    p2 = (xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)
    p = F.sqrt(F.greatest(p2 / 6, F.lit(1e-300)))
    a, b, c = (xx - q) / p, (yy - q) / p, (zz - q) / p
    d, e, f = xy / p, xz / p, yz / p
    half = (a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / 2
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half))) / 3
    largest = q + 2 * p * F.cos(phi)
    return largest, 3 * q - largest - smallest_eigenvalue(xx, xy, xz, yy, yz, zz)


def plane_normal(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column, l1: Column, l2: Column) -> Column:
    """struct(nx, ny, nz): the direction of least spread, upwards; (0, 0, 1) where it is undefined.

    The columns of (C - l1)(C - l2) all point along the remaining eigenvector; the longest is used.
    """
    a = ((xx - l1, xy, xz), (xy, yy - l1, yz), (xz, yz, zz - l1))
    b = ((xx - l2, xy, xz), (xy, yy - l2, yz), (xz, yz, zz - l2))
    cols = [tuple(dot(a[i], (b[0][j], b[1][j], b[2][j])) for i in range(3)) for j in range(3)]
    sizes = [norm(c) for c in cols]
    best = F.greatest(*sizes)

    def pick(i: int) -> Column:
        return F.when(sizes[0] == best, cols[0][i]).when(sizes[1] == best, cols[1][i]).otherwise(cols[2][i])

    flat = best < 1e-12
    z = pick(2) / best
    up = F.when(z < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.struct(
        F.when(flat, F.lit(0.0)).otherwise(up * pick(0) / best).alias("nx"),
        F.when(flat, F.lit(0.0)).otherwise(up * pick(1) / best).alias("ny"),
        F.when(flat, F.lit(1.0)).otherwise(up * z).alias("nz"),
    )


def slope(nz: Column) -> Column:
    return F.acos(F.least(F.abs(nz), F.lit(1.0)))


def roughness(least: Column) -> Column:
    return F.sqrt(F.greatest(least, F.lit(0.0)))


def inflation(d: Column, robot_radius: float, inflation_radius: float, factor: float, lethal_cost: float) -> Column:
    """Cost of a node at distance ``d`` from an obstacle; null (no obstacle near) and beyond the rim: 0."""
    decay = (lethal_cost - 1.0) * F.exp(-factor * F.greatest(d - robot_radius, F.lit(0.0)))
    return F.when(d <= inflation_radius, decay).otherwise(F.lit(0.0))


def edge_allowed(dxy: Column, dz: Column, length: Column, tan_slope: float, max_step: float) -> Column:
    return (dz <= F.greatest(dxy * tan_slope, F.lit(max_step))) & (length > 1e-9)


def edge_weight(length: Column, cost_a: Column, cost_b: Column, weight: float) -> Column:
    return length * (1.0 + weight * 0.5 * (cost_a + cost_b))


def heading_quaternion(nx: Column, ny: Column, nz: Column, yaw: Column) -> Column:
    """struct(qx, qy, qz, qw) of a body whose up axis is the normal and whose front lies over ``yaw``."""
    size = F.greatest(norm((nx, ny, nz)), F.lit(1e-12))
    n = (nx / size, ny / size, nz / size)
    f0 = (F.cos(yaw), F.sin(yaw), F.lit(0.0))
    along = dot(f0, n)
    f1 = tuple(f - along * m for f, m in zip(f0, n, strict=True))
    s1 = norm(f1)
    bad = s1 < 1e-9
    f = tuple(F.when(bad, F.lit(v)).otherwise(x / s1) for x, v in zip(f1, (1.0, 0.0, 0.0), strict=True))
    left = cross(n, f)
    return matrix_quaternion(((f[0], left[0], n[0]), (f[1], left[1], n[1]), (f[2], left[2], n[2])))


def matrix_quaternion(m: tuple[Vec, Vec, Vec]) -> Column:
    """struct(qx, qy, qz, qw) of a rotation matrix, dividing by its largest component."""
    (a, b, c), (d, e, f), (g, h, i) = m
    trace = a + e + i

    def made(s2: Column, *parts: Column) -> Column:
        return F.struct(*(p.alias(n) for p, n in zip(parts, ("qx", "qy", "qz", "qw"), strict=True)))

    root = lambda x: F.sqrt(F.greatest(x, F.lit(1e-12)))
    s = 2 * root(trace + 1)
    sx, sy, sz = 2 * root(1 + a - e - i), 2 * root(1 + e - a - i), 2 * root(1 + i - a - e)
    return (
        F.when(trace > 0, made(s, (h - f) / s, (c - g) / s, (d - b) / s, s / 4))
        .when((a > e) & (a > i), made(sx, sx / 4, (b + d) / sx, (c + g) / sx, (h - f) / sx))
        .when(e > i, made(sy, (b + d) / sy, sy / 4, (f + h) / sy, (c - g) / sy))
        .otherwise(made(sz, (c + g) / sz, (f + h) / sz, sz / 4, (d - b) / sz))
    )


#: Stops of the cost ramp (share of the lethal cost, red, green, blue) and the lethal colour.
RAMP = ((0.0, 47, 158, 110), (0.35, 200, 185, 59), (0.7, 224, 123, 57), (1.0, 192, 57, 43))
LETHAL_RGB = (150, 40, 45)


def interpolate(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise linear through ``knots``, constant beyond its ends."""
    out = F.when(x <= knots[0][0], F.lit(float(knots[0][1])))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        out = out.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.lit(float(knots[-1][1])))


def cost_rgb(cost: Column, lethal: Column, lethal_cost: float) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), cost / max(lethal_cost, 1e-6)))
    part = lambda k: F.when(lethal, F.lit(LETHAL_RGB[k])).otherwise(F.floor(interpolate(t, [(s[0], s[k + 1]) for s in RAMP])).cast("int"))
    return F.struct(*(part(k).alias(n) for k, n in enumerate("rgb")))
