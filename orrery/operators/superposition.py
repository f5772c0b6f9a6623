"""Optimal superposition, planes and spatial distributions: all from sums by group, so that points are never gathered."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import geometry as g
from orrery.operators import properties as p
from orrery.operators import spatial
from orrery.schema import System

VOXELS = 128
_AXES = [(a, b) for a in "xyz" for b in "xyz"]


def cross_covariance(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(frame, by, w, ga, gb, xx, xy, ..): mass-weighted second moments of the first frame's points with each frame's, each about its centre.

    ``points``: (frame, by, k, x, y, z, mass).  ``ga`` and ``gb`` are the sums of squares of both.
    """
    first = points.agg(F.min("frame").alias("f0"))
    start = points.join(F.broadcast(first), F.col("frame") == F.col("f0")).select(*by, "k", *[F.col(c).alias(f"a{c}") for c in "xyz"])  # one row is broadcast
    both = points.join(start, [*by, "k"])
    w = F.sum("mass")
    mean = {c: F.sum(F.col(c) * F.col("mass")) / w for c in ("x", "y", "z", "ax", "ay", "az")}
    moment = lambda a, b: F.sum(F.col(a) * F.col(b) * F.col("mass")) - mean[a] * mean[b] * w
    square = lambda names: sum((moment(c, c) for c in names[1:]), moment(names[0], names[0]))
    return both.groupBy("frame", *by).agg(w.alias("w"), square(["ax", "ay", "az"]).alias("ga"), square(["x", "y", "z"]).alias("gb"), *[moment(f"a{a}", b).alias(a + b) for a, b in _AXES])


def rmsd(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(frame, by, value): to the first frame, after the best rotation.  Molecules must be whole.

    The best rotation's overlap is the sum of the singular values of the moments, the least one negative where they mirror;
    singular values are the roots of the eigenvalues of the matrix times itself.
    """
    c = cross_covariance(points, by)
    m = [[F.col(a + b) for b in "xyz"] for a in "xyz"]
    square = [[m[0][i] * m[0][j] + m[1][i] * m[1][j] + m[2][i] * m[2][j] for j in range(3)] for i in range(3)]
    # each step has columns of its own, so that expressions are not multiplied out
    c = c.withColumns({f"s{i}{j}": square[i][j] for i in range(3) for j in range(i, 3)})
    l1, l2, l3 = g.eigenvalues(*[F.col(x) for x in ("s00", "s11", "s22", "s01", "s02", "s12")])
    c = c.withColumns({"l1": l1, "l2": l2, "l3": l3})
    det = m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    root = lambda x: F.sqrt(F.greatest(F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)))
    overlap = root(F.col("l1")) + root(F.col("l2")) + root(F.col("l3")) * F.when(det < 0, -1.0).otherwise(1.0)
    return c.select("frame", *by, F.sqrt(F.greatest((F.col("ga") + F.col("gb") - 2 * overlap) / F.col("w"), F.lit(0.0))).alias("value"))


def plane(points: DataFrame, by: Sequence[str] = ("frame",)) -> DataFrame:
    """(by, nx, ny, nz, d): the plane of least squares, n . x = d; the largest component of n is positive.  Fewer than three points give none."""
    t = points.withColumn("mass", F.lit(1.0))
    n = t.groupBy(*by).agg(F.count("*").alias("_n"), *[F.avg(c).alias(f"m{c}") for c in "xyz"]).filter("_n >= 3")
    c = p.covariance(t, by).join(n, list(by))
    m = [[F.col("".join(sorted((a, b)))) for b in "xyz"] for a in "xyz"]
    c = c.withColumn("least", g.eigenvalues(*[F.col(x) for x in ("xx", "yy", "zz", "xy", "xz", "yz")])[2])
    v = g.eigenvector(m, F.col("least"))
    c = c.select(*by, "mx", "my", "mz", *[x.alias(f"v{a}") for x, a in zip(v, "xyz", strict=True)])
    size = F.greatest(*[F.abs(F.col(f"v{a}")) for a in "xyz"])
    sign = F.when(F.abs("vx") == size, F.signum("vx")).when(F.abs("vy") == size, F.signum("vy")).otherwise(F.signum("vz"))
    c = c.select(*by, "mx", "my", "mz", *[(F.col(f"v{a}") * sign).alias(f"n{a}") for a in "xyz"])
    return c.select(*by, "nx", "ny", "nz", (F.col("nx") * F.col("mx") + F.col("ny") * F.col("my") + F.col("nz") * F.col("mz")).alias("d"))


def rotation(moments: np.ndarray) -> np.ndarray:
    """The rotation that takes the second points of 3 x 3 moments (first by second) onto the first."""
    u, _, vt = np.linalg.svd(moments)
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ vt)) or 1.0])
    return u @ flip @ vt


def _rotations(axes: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(axes @ rotation(m.reshape(3, 3))).ravel() for m in b[[a + c for a, c in _AXES]].to_numpy()]
            out = b[["frame", "g", "cx", "cy", "cz"]].copy()
            for i in range(9):
                out[f"r{i}"] = [r[i] for r in found]
            yield out

    return run


def oriented_bounds(points: DataFrame, by: Sequence[str] = ("frame",)) -> DataFrame:
    """(by, size_1, size_2, size_3): extents along the principal axes, the largest moment first."""
    c = p.covariance(points, by)
    m = [[F.col("".join(sorted((a, b)))) for b in "xyz"] for a in "xyz"]
    first, _, last = g.eigenvalues(*[F.col(x) for x in ("xx", "yy", "zz", "xy", "xz", "yz")])
    c = c.withColumns({"first": first, "last": last})
    u, v = g.eigenvector(m, F.col("first")), g.eigenvector(m, F.col("last"))
    c = c.select(*by, *[x.alias(f"u{a}") for x, a in zip(u, "xyz", strict=True)], *[x.alias(f"w{a}") for x, a in zip(v, "xyz", strict=True)])
    t = points.join(c, list(by))
    axes = [g.vec("u"), g.cross(g.vec("w"), g.vec("u")), g.vec("w")]
    along = [g.dot(a, g.vec()) for a in axes]
    return t.groupBy(*by).agg(*[(F.max(x) - F.min(x)).alias(f"size_{i}") for i, x in enumerate(along, 1)])


def sdf(s: System, references: DataFrame, target: DataFrame, radius: float, voxels: int = VOXELS) -> DataFrame:
    """(frame, ix, iy, iz, value): targets counted in voxels about references, each turned onto the first reference of the first frame.

    ``references`` (group_id, atom_idx): groups of as many atoms, alike in order; ``target`` (atom_idx).  A reference's own
    atoms do not count.  The axes are the principal ones of the first reference; the cube has sides of twice the radius.
    """
    w = Window.partitionBy("g").orderBy("atom_idx")
    refs = references.select(F.col("group_id").alias("g"), "atom_idx").withColumn("k", F.row_number().over(w))
    t = s.trajectory.join(refs, "atom_idx").join(s.atoms.select("atom_idx", "mass"), "atom_idx")
    frame, group = t.agg(F.min("frame")).first()[0], refs.agg(F.min("g")).first()[0]
    if frame is None:
        return s.trajectory.sparkSession.createDataFrame([], "frame int, ix int, iy int, iz int, value double")
    start = t.filter((F.col("frame") == frame) & (F.col("g") == group)).select("k", *[F.col(c).alias(f"a{c}") for c in "xyz"])
    c = p.covariance(t.filter((F.col("frame") == frame) & (F.col("g") == group)), ("frame",)).first()
    values, vectors = np.linalg.eigh(np.array([[c["xx"], c["xy"], c["xz"]], [c["xy"], c["yy"], c["yz"]], [c["xz"], c["yz"], c["zz"]]]))
    axes = vectors[:, ::-1].T
    if np.linalg.det(axes) < 0:
        axes[2] *= -1
    both, total = t.join(start, "k"), F.sum("mass")
    mean = {x: F.sum(F.col(x) * F.col("mass")) / total for x in ("x", "y", "z", "ax", "ay", "az")}
    moments = both.groupBy("frame", "g").agg(*[mean[x].alias(f"c{x}") for x in "xyz"], *[(F.sum(F.col(f"a{a}") * F.col(b) * F.col("mass")) - mean[f"a{a}"] * mean[b] * total).alias(a + b) for a, b in _AXES])
    kind = dict(t.dtypes)
    turned = moments.mapInPandas(_rotations(axes), f"frame {kind['frame']}, g {kind['g']}, cx double, cy double, cz double, " + ", ".join(f"r{i} double" for i in range(9)))
    centres = turned.select("frame", (-F.col("g") - 1).cast("long").alias("atom_idx"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    near = spatial.range_join(centres, s.trajectory.join(target.select("atom_idx").distinct(), "atom_idx"), radius * 3 ** 0.5, s.cell).select("frame", (-F.col("i") - 1).alias("g"), F.col("j").alias("atom_idx"))
    near = near.join(refs.select("g", "atom_idx"), ["g", "atom_idx"], "left_anti").join(s.trajectory, ["frame", "atom_idx"]).join(turned, ["frame", "g"])
    d = g.delta(g.vec("c"), g.vec(), s.cell)
    near = near.filter(sum((F.abs(x) <= radius).cast("int") for x in d) == 3)
    at = [F.floor((F.col(f"r{3 * i}") * d[0] + F.col(f"r{3 * i + 1}") * d[1] + F.col(f"r{3 * i + 2}") * d[2]) * (voxels / (2 * radius)) + voxels / 2) for i in range(3)]
    inside = [F.greatest(F.lit(0), F.least(F.lit(voxels - 1), x)).cast("int").alias(n) for x, n in zip(at, ("ix", "iy", "iz"), strict=True)]
    return near.select("frame", *inside).groupBy("frame", "ix", "iy", "iz").agg(F.count("*").cast("double").alias("value"))
