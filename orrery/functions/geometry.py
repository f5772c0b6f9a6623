"""Geometry as column expressions; an axis of length 0 has no period."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(prefix: str = "") -> Vec:
    return F.col(f"{prefix}x"), F.col(f"{prefix}y"), F.col(f"{prefix}z")


def nearest(x: Column) -> Column:
    """The nearest whole number, of two the one further from 0: as round(), which goes by way of decimals and is slow."""
    a = F.abs(x)
    return F.signum(x) * (F.rint(a) + F.when(a - F.rint(a) == 0.5, 1.0).otherwise(0.0))


def min_image(d: Column, length: float) -> Column:
    return d - F.lit(length) * nearest(d / F.lit(length)) if length else d


def distance2(a: Vec, b: Vec, cell: Sequence[float] = (0, 0, 0)) -> Column:
    """Squared, by the shortest image; of two that are as short, either."""
    d = tuple(q - p - F.lit(n) * F.rint((q - p) / F.lit(n)) if n else q - p for p, q, n in zip(a, b, cell, strict=True))
    return dot(d, d)


def delta(a: Vec, b: Vec, cell: Sequence[float] = (0, 0, 0)) -> Vec:
    return tuple(min_image(q - p, n) for p, q, n in zip(a, b, cell, strict=True))


def wrap(x: Column, length: float) -> Column:
    return x - F.lit(length) * F.floor(x / F.lit(length)) if length else x


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def angle(a: Vec, b: Vec, c: Vec) -> Column:
    """At b, in radians."""
    u, v = delta(b, a), delta(b, c)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(u, v) / (norm(u) * norm(v)))))


def dihedral(p: Sequence[Vec], cell: Sequence[float] = (0, 0, 0)) -> Column:
    """Signed, of four points, in radians."""
    b1, b2, b3 = (delta(a, b, cell) for a, b in zip(p, p[1:], strict=False))
    n1, n2 = cross(b1, b2), cross(b2, b3)
    return F.atan2(norm(b2) * dot(b1, n2), dot(n1, n2))


def eigenvalues(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> tuple[Column, Column, Column]:
    """Of a symmetric 3 x 3 matrix, the largest first, in closed form."""
    q = (xx + yy + zz) / 3
    p = F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6)
    a, b, c, d, e, f = (xx - q) / p, (yy - q) / p, (zz - q) / p, xy / p, xz / p, yz / p
    r = (a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / 2
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))) / 3
    first, last = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2.0943951023931953)
    return first, 3 * q - first - last, last


def eigenvector(m: Sequence[Sequence[Column]], value: Column) -> Vec:
    """Of a symmetric 3 x 3 matrix for a single eigenvalue: the longest cross product of two rows of m - value."""
    rows = [tuple(m[i][j] - value if i == j else m[i][j] for j in range(3)) for i in range(3)]
    found = [cross(rows[i], rows[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    sizes = [dot(v, v) for v in found]
    best = F.greatest(*sizes)
    pick = lambda k: F.coalesce(*[F.when(s == best, v[k]) for s, v in zip(sizes, found, strict=True)]) / F.sqrt(best)
    return pick(0), pick(1), pick(2)


# --- triclinic cells: rows of the matrix are the lattice vectors (ax, 0, 0), (bx, by, 0), (cx, cy, cz) -------------------
def cell_from_angles(a: float, b: float, c: float, alpha: float, beta: float, gamma: float) -> list[list[float]]:
    """From lengths and angles in degrees."""
    ca, cb, cg = (math.cos(math.radians(x)) for x in (alpha, beta, gamma))
    lx, xy, xz = a, b * cg, c * cb
    ly = math.sqrt(max(0.0, b * b - xy * xy))
    yz = (b * c * ca - xy * xz) / ly
    return [[lx, 0.0, 0.0], [xy, ly, 0.0], [xz, yz, math.sqrt(max(0.0, c * c - xz * xz - yz * yz))]]


def inverse(m: Sequence[Sequence[float]]) -> list[list[float]]:
    (a, _, _), (b, c, _), (d, e, f) = m
    return [[1 / a, 0.0, 0.0], [-b / (a * c), 1 / c, 0.0], [(b * e - c * d) / (a * c * f), -e / (c * f), 1 / f]]


def metric(m: Sequence[Sequence[float]]) -> list[list[float]]:
    """Scalar products of the lattice vectors."""
    return [[sum(x * y for x, y in zip(p, q, strict=True)) for q in m] for p in m]


def _times(v: Sequence[Column], m: Sequence[Sequence[float]]) -> Vec:
    return tuple(sum((v[i] * F.lit(float(m[i][k])) for i in range(1, 3)), v[0] * F.lit(float(m[0][k]))) for k in range(3))


def fractional(v: Vec, m: Sequence[Sequence[float]]) -> Vec:
    return _times(v, inverse(m))


def cartesian(v: Vec, m: Sequence[Sequence[float]]) -> Vec:
    return _times(v, m)


def wrap_triclinic(v: Vec, m: Sequence[Sequence[float]]) -> Vec:
    return cartesian(tuple(x - F.floor(x) for x in fractional(v, m)), m)


def min_image_triclinic(d: Vec, m: Sequence[Sequence[float]]) -> Vec:
    """The shortest of the 27 images about the reduced vector."""
    reduced = cartesian(tuple(x - F.round(x) for x in fractional(d, m)), m)
    shifts = [tuple(sum(n[i] * m[i][k] for i in range(3)) for k in range(3)) for n in itertools.product((-1, 0, 1), repeat=3)]
    images = F.transform(F.array(*[F.struct(*[F.lit(float(x)).alias(c) for c, x in zip("xyz", s, strict=True)]) for s in shifts]),
                         lambda s: F.struct(F.round((reduced[0] + s["x"]) ** 2 + (reduced[1] + s["y"]) ** 2 + (reduced[2] + s["z"]) ** 2, 9).alias("d"), *[(r + s[c]).alias(c) for r, c in zip(reduced, "xyz", strict=True)]))
    best = F.array_min(images)
    return best["x"], best["y"], best["z"]


def grid_to_world(index: Vec, origin: Sequence[float], axes: Sequence[Sequence[float]]) -> Vec:
    """Of a voxel's centre; ``axes`` are the steps along each index."""
    return tuple(o + x for o, x in zip(map(F.lit, map(float, origin)), (sum((index[i] * F.lit(float(axes[i][k])) for i in range(1, 3)), index[0] * F.lit(float(axes[0][k]))) for k in range(3)), strict=True))


def world_to_grid(v: Vec, origin: Sequence[float], steps: Sequence[float]) -> Vec:
    """The voxel that holds a point, for axes along x, y and z."""
    return tuple(F.floor((c - float(o)) / float(s) + 0.5).cast("int") for c, o, s in zip(v, origin, steps, strict=True))
