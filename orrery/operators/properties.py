"""Computed properties: one aggregate for each frame."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import geometry as g
from orrery.operators import pairs as pairwise
from orrery.operators import spatial
from orrery.schema import System

DENSITY = 1660.5390666
BINS = 1024


def positions(s: System, sel: DataFrame) -> DataFrame:
    """(frame, atom_idx, x, y, z, mass, comp_idx) of a selection; a group_id stays."""
    t = s.trajectory.join(sel, "atom_idx")
    return t.join(s.atoms.select("atom_idx", "mass", "comp_idx"), "atom_idx")


def com(points: DataFrame, by: Sequence[str] = ("frame",)) -> DataFrame:
    m = F.sum("mass")
    return points.groupBy(*by).agg(*[(F.sum(F.col(c) * F.col("mass")) / m).alias(c) for c in "xyz"])


def com_periodic(points: DataFrame, cell: Sequence[float], by: Sequence[str] = ("frame",)) -> DataFrame:
    """By the circular mean along each periodic axis."""
    out: list[Column] = []
    for c, n in zip("xyz", cell, strict=True):
        a = F.col(c) * F.lit(2 * 3.141592653589793 / n) if n else None
        mean = F.sum(F.col(c) * F.col("mass")) / F.sum("mass") if a is None else g.wrap(
            F.atan2(F.sum(F.sin(a) * F.col("mass")), F.sum(F.cos(a) * F.col("mass"))) * F.lit(n / (2 * 3.141592653589793)), n)
        out.append(mean.alias(c))
    return points.groupBy(*by).agg(*out)


def prefixed(df: DataFrame, prefix: str, keys: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    """Coordinates, and more columns, under names with a prefix."""
    return df.select(*keys, *[F.col(c).alias(f"{prefix}{c}") for c in (*more, *"xyz")])


def _side(df: DataFrame, prefix: str) -> DataFrame:
    return df.select("frame", *[F.col(c).alias(f"{prefix}{c}") for c in "xyz"])


def distance(a: DataFrame, b: DataFrame, cell: Sequence[float]) -> DataFrame:
    """Between the centres of mass of two sets of points."""
    both = _side(com(a), "a").join(_side(com(b), "b"), "frame")
    return both.select("frame", g.norm(g.delta(g.vec("a"), g.vec("b"), cell)).alias("value"))


def distance_pairs(a: DataFrame, b: DataFrame, cell: Sequence[float], parts: int = 1) -> DataFrame:
    """(frame, i, j, d) for all pairs: the result itself has as many rows as pairs.

    ``parts``: those of each frame that are dealt out, with a copy of the frame's second points for each.
    """
    x = a.select("frame", F.col("atom_idx").alias("i"), *[F.col(c).alias(f"a{c}") for c in "xyz"], F.pmod(F.xxhash64("atom_idx"), F.lit(parts)).alias("_part"))
    y = b.select("frame", F.col("atom_idx").alias("j"), *[F.col(c).alias(f"b{c}") for c in "xyz"], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("_part"))
    return x.join(y, ["frame", "_part"]).select("frame", "i", "j", F.sqrt(g.distance2(g.vec("a"), g.vec("b"), cell)).alias("d"))


def angle(a: DataFrame, b: DataFrame, c: DataFrame) -> DataFrame:
    t = _side(com(a), "a").join(_side(com(b), "b"), "frame").join(_side(com(c), "c"), "frame")
    return t.select("frame", g.angle(g.vec("a"), g.vec("b"), g.vec("c")).alias("value"))


def dihedral(parts: Sequence[DataFrame], cell: Sequence[float]) -> DataFrame:
    t = _side(com(parts[0]), "a")
    for p, n in zip(parts[1:], "bcd", strict=True):
        t = t.join(_side(com(p), n), "frame")
    return t.select("frame", g.dihedral([g.vec(n) for n in "abcd"], cell).alias("value"))


def rdf(a: DataFrame, b: DataFrame, cell: Sequence[float], high: float, low: float = 0.0, bins: int = BINS) -> DataFrame:
    """(frame, bin, n): counts of pair distances; bins of equal width from ``low`` up to ``high``."""
    return pairwise.histogram(a, b, cell, max(low, 1e-3), high, (high - low) / bins, bins)


def rdf_weighted(a: DataFrame, b: DataFrame, cell: Sequence[float], high: float, low: float = 0.0, bins: int = BINS) -> DataFrame:
    """(frame, bin, n, weight): counts, and what a bin of its volume would hold if the pairs found were spread evenly."""
    counts = rdf(a, b, cell, high, low, bins)
    step = (high - low) / bins
    total = F.sum("n").over(Window.partitionBy("frame"))
    ball = lambda r: r * r * r * (4 * 3.141592653589793 / 3)
    outer = ball(F.lit(low) + (F.col("bin") + 0.5) * step)
    inner = F.when(F.col("bin") > 0, ball(F.lit(low) + (F.col("bin") - 0.5) * step)).otherwise(F.lit(0.0))
    return counts.withColumn("_pairs", total).select("frame", "bin", "n", (F.col("_pairs") / (ball(F.lit(float(high))) - ball(F.lit(float(low)))) * (outer - inner)).alias("weight"))


def count_level(s: System, found: DataFrame, level: str = "atom") -> DataFrame:
    """(ctx, value): the atoms, residues, chains or structures that a selection (ctx, atom_idx) touches."""
    if level == "structure":
        found, key = found.join(structures(s), "atom_idx"), "structure"
    elif level in ("residue", "component", "chain", "instance"):
        found = found.join(s.atoms.select("atom_idx", "comp_idx"), "atom_idx").join(s.components.select("comp_idx", "inst_idx"), "comp_idx")
        key = "comp_idx" if level in ("residue", "component") else "inst_idx"
    elif level == "atom":
        key = "atom_idx"
    else:
        raise ValueError(f"no such level: {level}")
    return found.groupBy("ctx").agg(F.count_distinct(key).alias("value"))


def as_of(frames: DataFrame, rows: DataFrame, tolerance: float) -> DataFrame:
    """(frame, value) of the rows (t, value) whose time equals a frame's (frame, time) within the tolerance: an equi-join on buckets and their neighbours."""
    width = 2 * tolerance
    f = frames.withColumn("_b", F.explode(F.array(*[F.floor(F.col("time") / width) + i for i in (-1, 0, 1)])))
    return f.join(rows.withColumn("_b", F.floor(F.col("t") / width)), "_b").filter(F.abs(F.col("t") - F.col("time")) <= tolerance).drop("_b")


def density(points: DataFrame, axis: str, cell: Sequence[float], bins: int = BINS) -> DataFrame:
    """(frame, bin, value): mass density in slices along an axis, in kg/m3."""
    n = cell["xyz".index(axis)]
    at = F.least(F.floor(F.round(g.wrap(F.col(axis), n), 9) / (n / bins)), F.lit(bins - 1))
    volume = cell[0] * cell[1] * cell[2] / bins
    return points.groupBy("frame", at.alias("bin")).agg((F.sum("mass") * DENSITY / volume).alias("value"))


def covariance(points: DataFrame, by: Sequence[str] = ("frame",)) -> DataFrame:
    """Mass-weighted second moments about the centre of mass, from sums alone."""
    m = F.sum("mass")
    mean = {c: F.sum(F.col(c) * F.col("mass")) / m for c in "xyz"}
    return points.groupBy(*by).agg(*[(F.sum(F.col(a) * F.col(b) * F.col("mass")) / m - mean[a] * mean[b]).alias(a + b) for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")])


def shape_weights(points: DataFrame, by: Sequence[str] = ("frame",)) -> DataFrame:
    """Linear, planar and isotropic weights."""
    c = covariance(points, by)
    a, b, d = g.eigenvalues(*[F.col(n) for n in ("xx", "yy", "zz", "xy", "xz", "yz")])
    c = c.select(*by, a.alias("l1"), b.alias("l2"), d.alias("l3"))
    total = F.col("l1") + F.col("l2") + F.col("l3")
    return c.select(*by, ((F.col("l1") - F.col("l2")) / total).alias("linear"), (2 * (F.col("l2") - F.col("l3")) / total).alias("planar"), (3 * F.col("l3") / total).alias("isotropic"))


def bounds(points: DataFrame, by: Sequence[str] = ("frame",), radius: str | None = None) -> DataFrame:
    """The least box about the points, or about spheres of the radius column."""
    r = F.col(radius) if radius else F.lit(0.0)
    return points.groupBy(*by).agg(*[f(F.col(c) + r if n == "max" else F.col(c) - r).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"])


def contacts(s: System, a: DataFrame, b: DataFrame, cutoff: float, hops: int = 4) -> DataFrame:
    """(frame, group_id, n): pairs of atoms of a group's with atoms of ``b``, not further apart than the cutoff.

    Atoms of ``b`` that the group shares, and those that are up to ``hops`` bonds from the shared ones, do not count.
    """
    groups = a.select("group_id", F.col("atom_idx").alias("i")).distinct()
    shared = groups.join(b.select(F.col("atom_idx").alias("i")).distinct(), "i", "left_semi")
    edges = s.bonds.select("i", "j").union(s.bonds.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct()
    for _ in range(hops):  # each hop reads the one before once
        shared = shared.join(edges, "i", "left").select(F.explode(F.array("i", F.coalesce("j", "i"))).alias("i"), "group_id").distinct()
    left = a.select("frame", "group_id", "atom_idx", "x", "y", "z").distinct()
    n = pairwise.count_by_group(left, b, cutoff, s.cell)
    own = b.select("frame", "atom_idx", "x", "y", "z").join(shared.withColumnRenamed("i", "atom_idx"), "atom_idx")
    less = pairwise.count_by_group(left.join(own.select("group_id").distinct(), "group_id", "left_semi"), own, cutoff, s.cell)
    n = n.join(less.withColumnRenamed("n", "_less"), ["frame", "group_id"], "left")
    return n.select("frame", "group_id", (F.col("n") - F.coalesce("_less", F.lit(0))).alias("n")).filter("n > 0")


def interpolate(s: System, t: float) -> DataFrame:
    """(frame, atom_idx, x, y, z) between each frame and the next, across periodic borders."""
    t, w = min(1.0, max(0.0, t)), Window.partitionBy("atom_idx").orderBy("frame")
    out = s.trajectory
    for c, n in zip("xyz", s.cell, strict=True):
        out = out.withColumn(f"n{c}", F.lead(c).over(w))
    return out.filter("nx IS NOT NULL").select("frame", "atom_idx", *[(F.col(c) + g.min_image(F.col(f"n{c}") - F.col(c), n) * t).alias(c) for c, n in zip("xyz", s.cell, strict=True)])


def interpolate_cubic(s: System, t: float, tension: float = 0.5) -> DataFrame:
    """(frame, atom_idx, x, y, z) between each frame and the next, by a cardinal spline through four frames."""
    t, w = min(1.0, max(0.0, t)), Window.partitionBy("atom_idx").orderBy("frame")
    out = s.trajectory
    for c in "xyz":
        out = out.withColumns({f"a{c}": F.lag(c).over(w), f"c{c}": F.lead(c).over(w), f"d{c}": F.lead(c, 2).over(w)})

    def at(c: str, length: float) -> Column:
        # the other three points, seen from the one before t across periodic borders
        a = g.min_image(F.col(f"a{c}") - F.col(c), length)
        n = g.min_image(F.col(f"c{c}") - F.col(c), length)
        d = n + g.min_image(F.col(f"d{c}") - F.col(f"c{c}"), length)
        first, last = (n - a) * tension, d * tension
        return F.col(c) + first * t + (n * 3 - first * 2 - last) * (t * t) + (first + last - n * 2) * (t * t * t)

    return out.filter("ax IS NOT NULL AND dx IS NOT NULL").select("frame", "atom_idx", *[at(c, n).alias(c) for c, n in zip("xyz", s.cell, strict=True)])


def checkpoints(spark: SparkSession) -> None:
    """Sees to a folder for checkpoint(): the one that the cluster names; on one machine, where none is named, one of its own."""
    if not spark.sparkContext.getCheckpointDir():
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="orrery-"))


def structures(s: System) -> DataFrame:
    """(atom_idx, structure): the least atom of the connected structure of bonds, for each atom.

    Least labels spread along bonds and jump over what they have reached already, so rounds are about the logarithm of the
    longest path; each round is written by checkpoint(), in the folder that the cluster names.
    """
    checkpoints(s.atoms.sparkSession)
    edges = s.bonds.select("i", "j").union(s.bonds.select(F.col("j").alias("i"), F.col("i").alias("j"))).filter("i <> j").distinct().checkpoint()
    label = s.atoms.select("atom_idx", F.col("atom_idx").alias("structure"))
    while True:
        near = edges.join(label.toDF("j", "near"), "j").groupBy(F.col("i").alias("atom_idx")).agg(F.min("near").alias("near"))
        step = label.join(near, "atom_idx", "left").select("atom_idx", F.col("structure").alias("old"), F.least("structure", F.coalesce("near", "structure")).alias("structure")).checkpoint()
        far = step.select(F.col("atom_idx").alias("structure"), F.col("structure").alias("further"))
        moved = step.join(far, "structure").select("atom_idx", "old", F.col("further").alias("structure")).checkpoint()
        label = moved.select("atom_idx", "structure")
        if not moved.filter("structure <> old").limit(1).count():
            return label


def frame_stats(values: DataFrame, value: str = "value") -> DataFrame:
    return values.groupBy("frame").agg(F.avg(value).alias("mean"), F.var_pop(value).alias("var"), F.min(value).alias("min"), F.max(value).alias("max"))


# fixed values: atomic numbers of metals' usual partners in coordination
DONORS = (7, 8, 9, 15, 16, 17, 34, 35, 53)


def _metal(z: Column) -> Column:
    return z.isin(3, 4, 11, 12, 13) | z.between(19, 31) | z.between(37, 50) | z.between(55, 83) | (z >= 87)


def _transition(z: Column) -> Column:
    return z.between(21, 30) | z.between(39, 48) | z.between(72, 80) | z.between(104, 112)


def covalent_bonds(s: System, frame: int = 0) -> DataFrame:
    """(i, j): bonded pairs by their distance in multiples of the sum of their radii.

    From 0.65; up to 1.15 between atoms that are no metals, a twentieth more within a component; up to 1.30 between a metal
    and a donor element, neither in water; up to 0.90 between transition metals.  The search goes as far as the largest
    radii present may bond.  What tells a bond comes along with each atom, so pairs are judged where they are made.
    """
    most = s.atoms.agg(F.max("radius"), F.max(_metal(F.col("z")))).first()
    reach = (1.30 if most[1] else 1.15 * 1.05) * 2 * (most[0] or 0.0) * spatial.SLACK
    if not reach:
        return s.bonds.select("i", "j").limit(0)
    water = s.components.select("comp_idx", (F.col("flags").bitwiseAND(0x20000) != 0).alias("water"))
    z = F.col("z")
    r = s.atoms.select("atom_idx", F.col("radius").cast("double").alias("radius"), F.col("comp_idx").cast("long").alias("comp_idx"), _metal(z).alias("metal"), _transition(z).alias("transition"), z.isin(*DONORS).alias("donor")).join(water, "comp_idx")

    def bonded(d2: np.ndarray, a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
        total, d = a["radius"] + b["radius"], np.sqrt(d2)
        high = total * 1.15 * np.where(a["comp_idx"] == b["comp_idx"], 1.05, 1.0)
        if a["metal"].any() or b["metal"].any():
            donor = np.where(a["metal"], b["donor"], a["donor"]) & ~a["water"] & ~b["water"]
            mixed = np.where(donor, total * 1.30, -1.0)
            metals = np.where(a["transition"] & b["transition"], total * 0.90, -1.0)
            high = np.where(~a["metal"] & ~b["metal"], high, np.where(a["metal"] != b["metal"], mixed, metals))
        return (d > total * 0.65) & (d < high)

    points = s.trajectory.filter(F.col("frame") == frame).join(r, "atom_idx")
    return pairwise.chosen(points, reach, s.cell, ("radius", "comp_idx", "metal", "transition", "donor", "water"), bonded).select("i", "j")


def morton(points: DataFrame) -> DataFrame:
    """(atom_idx, key): the Z-order key of 10 bits an axis, one scale for all axes."""
    b = points.agg(*[f(c).alias(f"{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xyz"])
    extent = F.greatest(*[F.col(f"hi{c}") - F.col(f"lo{c}") for c in "xyz"])
    at = points.join(F.broadcast(b)).select("atom_idx", *[F.floor((F.col(c) - F.col(f"lo{c}")) / extent * 1023 + 0.5).cast("long").alias(c) for c in "xyz"])  # one row
    key = " | ".join(f"shiftleft(shiftright({c}, {i}) & 1L, {3 * i + k})" for i in range(10) for k, c in enumerate("xyz"))
    return at.select("atom_idx", F.expr(key).alias("key"))
