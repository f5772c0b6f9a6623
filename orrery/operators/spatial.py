"""Periodic range joins: points are put into cells no smaller than the cutoff, and only neighbouring cells are joined.

The equi-join on (frame, cell) is Catalyst's; what is left is a filter on the distance.  Cells shrink the pairs from the square
of the points to their number times the points in 27 cells.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import geometry as g


SLACK = 1 + 1e-9  # cells are that much wider than the cutoff, as differences of coordinates are rounded


def _count(length: float, cutoff: float) -> int:
    return max(1, int(length // (cutoff * SLACK))) if length else 0


def _axis_cell(axis: str, length: float, cutoff: float) -> Column:
    n = _count(length, cutoff)
    return F.least(F.floor(g.wrap(F.col(axis), length) / (length / n)), F.lit(n - 1)) if length else F.floor(F.col(axis) / (cutoff * SLACK))


def _celled(df: DataFrame, cutoff: float, cell: Sequence[float]) -> DataFrame:
    return df.withColumns({f"_{name}": _axis_cell(axis, length, cutoff) for axis, name, length in zip("xyz", "abc", cell, strict=True)})


def _spread(df: DataFrame, cutoff: float, cell: Sequence[float], half: bool) -> DataFrame:
    """A row for each cell around; ``half``: for one of each pair of opposite cells, where every axis has three cells or more."""
    counts = [_count(length, cutoff) for length in cell]
    offsets = [o for o in itertools.product(*[(0,) if n == 1 else (0, 1) if n == 2 else (-1, 0, 1) for n in counts]) if not half or o >= (0, 0, 0)]
    around = F.explode(F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip("abc", o, strict=True)], F.lit(o == (0, 0, 0)).alias("same")) for o in offsets])).alias("_o")
    df = df.select("*", around)
    at = {f"_{c}": F.pmod(F.col(f"_{c}") + F.col("_o")[c], F.lit(n)) if n else F.col(f"_{c}") + F.col("_o")[c] for c, n in zip("abc", counts, strict=True)}
    return df.withColumns(at).withColumn("_same", F.col("_o")["same"]).drop("_o")


def range_join(left: DataFrame, right: DataFrame, cutoff: float, cell: Sequence[float] = (0, 0, 0), ordered: bool = False) -> DataFrame:
    """(frame, i, j, d2) of all points of both sides, as (frame, atom_idx, x, y, z), no further apart than the cutoff; i <> j.

    ``ordered``: both sides are the same points, and of each pair only i < j is made.  Then half of the cells around
    suffices, unless an axis has fewer than three cells.
    """
    half = ordered and all(_count(length, cutoff) not in (1, 2) for length in cell)
    a = _spread(_celled(left.select("frame", F.col("atom_idx").alias("i"), "x", "y", "z"), cutoff, cell), cutoff, cell, half)
    b = _celled(right.select("frame", F.col("atom_idx").alias("j"), "x", "y", "z"), cutoff, cell).withColumnsRenamed({"x": "x2", "y": "y2", "z": "z2"})
    d2 = g.distance2(g.vec(), (F.col("x2"), F.col("y2"), F.col("z2")), cell)
    pairs = a.join(b, ["frame", "_a", "_b", "_c"])
    if half:
        pairs = pairs.filter("NOT _same OR i < j")
    else:
        pairs = pairs.filter("i < j" if ordered else "i <> j")
    i, j = (F.least("i", "j"), F.greatest("i", "j")) if half else (F.col("i"), F.col("j"))
    return pairs.select("frame", i.alias("i"), j.alias("j"), d2.alias("d2")).filter(F.col("d2") <= cutoff * cutoff)


def triclinic_join(left: DataFrame, right: DataFrame, cutoff: float, matrix: Sequence[Sequence[float]]) -> DataFrame:
    """``range_join`` in a triclinic cell: cells are cut in fractional space, as wide as the cutoff is across the faces."""
    (ax, _, _), (bx, by, _), (cx, cy, cz) = matrix
    volume = ax * by * cz
    faces = [math.hypot(by * cz, cz * bx, bx * cy - by * cx), math.hypot(0.0, ax * cz, ax * cy), ax * by]
    heights = [volume / f for f in faces]
    counts = tuple(max(1, int(h // (cutoff * SLACK))) for h in heights)

    def placed(df: DataFrame, name: str) -> DataFrame:
        f = g.fractional(g.vec(), matrix)
        return df.select("frame", F.col("atom_idx").alias(name), "x", "y", "z", *[F.least(F.floor((u - F.floor(u)) * n), F.lit(n - 1)).alias(f"_{c}") for u, n, c in zip(f, counts, "abc", strict=True)])

    cutoffs = tuple(n * SLACK * SLACK for n in counts)  # lengths of n cells of width 1
    a = _spread(placed(left, "i"), 1.0, cutoffs, False)
    b = placed(right, "j").withColumnsRenamed({"x": "x2", "y": "y2", "z": "z2"})
    pairs = a.join(b, ["frame", "_a", "_b", "_c"]).filter("i <> j")
    d = g.min_image_triclinic(tuple(F.col(f"{c}2") - F.col(c) for c in "xyz"), matrix)
    return pairs.select("frame", "i", "j", g.dot(d, d).alias("d2")).filter(F.col("d2") <= cutoff * cutoff)


def in_box(points: DataFrame, centre: Sequence[float], half: Sequence[float], cell: Sequence[float] = (0, 0, 0)) -> DataFrame:
    """The points in a box about a centre, across periodic borders."""
    inside = [F.abs(g.min_image(F.col(c) - float(o), n)) <= float(h) for c, o, h, n in zip("xyz", centre, half, cell, strict=True)]
    return points.filter(reduce(lambda a, b: a & b, inside))


def in_sphere(points: DataFrame, centre: Sequence[float], radius: float, cell: Sequence[float] = (0, 0, 0)) -> DataFrame:
    d = g.delta(tuple(F.lit(float(o)) for o in centre), g.vec(), cell)
    return points.filter(g.dot(d, d) <= float(radius) ** 2)


def grow_by_radius(points: DataFrame, chosen: DataFrame, radius: float, cell: Sequence[float] = (0, 0, 0)) -> DataFrame:
    """(frame, atom_idx): chosen atoms and all others near any of them."""
    own = points.join(chosen.select("atom_idx"), "atom_idx", "left_semi").select("frame", "atom_idx")
    return within(points, points.join(chosen.select("atom_idx"), "atom_idx", "left_semi"), radius, cell).union(own)


def within(points: DataFrame, reference: DataFrame, radius: float, cell: Sequence[float] = (0, 0, 0), least: float = 0.0) -> DataFrame:
    """(frame, atom_idx) near any reference point, without the reference atoms."""
    near = range_join(reference, points, radius, cell).filter(F.col("d2") >= least * least).select("frame", F.col("j").alias("atom_idx")).distinct()
    return near.join(reference.select("frame", "atom_idx"), ["frame", "atom_idx"], "left_anti")
