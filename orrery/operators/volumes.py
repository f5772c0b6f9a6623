"""Volumes: Gaussian orbitals on points and grids, manifolds of a scalar field, porosity."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import geometry as g
from orrery.operators import properties
from orrery.schema import System


# --- Gaussian orbitals -------------------------------------------------------------------------------------------------
def cutoff_radius(coeff: Column, alpha: Column, i: Column, j: Column, k: Column, value: float, rounds: int = 100) -> Column:
    """Where coeff * x^i y^j z^k * exp(-alpha r^2) falls to a value for good, in the direction where it is greatest; 0 if it never exceeds it.

    Without powers in closed form, else by a fixed-point iteration that falls from above.  No decay: infinite.
    """
    n = (i + j + k).cast("double")
    power = lambda b: F.when(b > 0, F.pow(b.cast("double"), b)).otherwise(1.0)
    size = F.abs(coeff) * F.sqrt(power(i) * power(j) * power(k) / power(n))
    top = F.sqrt(n / (2 * alpha))
    highest = size * F.pow(top, n) * F.exp(-n / 2)
    step = lambda d, _: F.sqrt(F.greatest(F.lit(0.0), F.ln(size * F.pow(d, n) / value) / alpha))
    far = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), top + 100 / F.sqrt(alpha), step)
    return F.when(alpha == 0, F.lit(float("inf"))).when(F.coalesce(highest, F.lit(0.0)) < value, 0.0).when(n == 0, F.sqrt(F.ln(size / value) / alpha)).otherwise(far)


def evaluate(points: DataFrame, orbitals: DataFrame, squared: bool = False) -> DataFrame:
    """(point, value): the sum of orbitals (x, y, z, coeff, alpha, i, j, k, cutoff) at points (point, x, y, z), each within its cutoff; ``squared``: of the sum.

    An equi-join on cells as wide as the largest cutoff; points that no orbital reaches are 0.  Orbitals whose cutoff is not
    finite are refused.
    """
    widest = orbitals.agg(F.max("cutoff")).first()[0] or 0.0
    if widest == float("inf"):
        raise ValueError("give orbitals that do not decay a finite cutoff")
    if not widest:
        return points.select("point", F.lit(0.0).alias("value"))
    at = lambda c: F.floor(F.col(c) / widest).cast("long")
    around = F.explode(F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip("abc", o, strict=True)]) for o in itertools.product((-1, 0, 1), repeat=3)])).alias("_o")
    o = orbitals.filter("cutoff > 0").select("coeff", "alpha", "i", "j", "k", "cutoff", *[F.col(c).alias(f"o{c}") for c in "xyz"], *[at(c).alias(f"_{n}") for c, n in zip("xyz", "abc", strict=True)]).select("*", around)
    o = o.withColumns({f"_{n}": F.col(f"_{n}") + F.col("_o")[n] for n in "abc"}).drop("_o")
    p = points.select("point", "x", "y", "z", *[at(c).alias(f"_{n}") for c, n in zip("xyz", "abc", strict=True)])
    d = {c: F.col(c) - F.col(f"o{c}") for c in "xyz"}
    r2 = d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"]
    near = p.join(o, ["_a", "_b", "_c"]).withColumn("_r", r2).filter(F.col("_r") <= F.col("cutoff") * F.col("cutoff"))
    one = F.col("coeff") * F.pow(d["x"], F.col("i")) * F.pow(d["y"], F.col("j")) * F.pow(d["z"], F.col("k")) * F.exp(-F.col("alpha") * F.col("_r"))
    total = near.groupBy("point").agg(F.sum(one).alias("_v"))
    value = F.coalesce("_v", F.lit(0.0))
    return points.select("point").join(total, "point", "left").select("point", (value * value if squared else value).alias("value"))


def grid(spark: SparkSession, origin: tuple[float, float, float], step: float, counts: tuple[int, int, int]) -> DataFrame:
    """(point, ix, iy, iz, x, y, z): the points of a grid, z fastest; ``point`` counts them from 0."""
    nx, ny, nz = counts
    p = spark.range(0, nx * ny * nz).withColumnRenamed("id", "point")
    p = p.withColumns({"ix": F.expr(f"point div {ny * nz}"), "iy": F.expr(f"point div {nz} % {ny}"), "iz": F.expr(f"point % {nz}")})
    return p.withColumns({c: F.lit(float(o)) + F.col(f"i{c}") * float(step) for c, o in zip("xyz", origin, strict=True)})


# --- manifolds of a scalar field ---------------------------------------------------------------------------------------
def manifolds(volume: DataFrame, rising: bool = True) -> DataFrame:
    """(id, top): the maximum (or minimum) that each voxel of (id, ix, iy, iz, value) runs to, over the steepest of its 26 neighbours.

    Equal values are ordered by id.  A voxel sends its value to those around it, so that the choice is one aggregate with
    partial sums; paths are then halved round by round, each round written by checkpoint().  Voxels without a value, or with
    NaN, take no part.
    """
    properties.checkpoints(volume.sparkSession)
    v = volume.select("id", *[F.col(f"i{c}").cast("long").alias(f"i{c}") for c in "xyz"], F.col("value").cast("double").alias("value")).filter("value IS NOT NULL AND NOT isnan(value)")
    around = F.explode(F.array(*[F.struct(*[F.lit(k).cast("long").alias(c) for c, k in zip("xyz", o, strict=True)]) for o in itertools.product((-1, 0, 1), repeat=3)])).alias("_o")
    sent = v.select("*", around).select(F.struct("value", "id").alias("_s"), *[(F.col(f"i{c}") + F.col("_o")[c]).alias(f"i{c}") for c in "xyz"])
    best = (F.max if rising else F.min)("_s")
    chosen = sent.groupBy("ix", "iy", "iz").agg(best.alias("_b"))
    to = v.join(chosen, ["ix", "iy", "iz"]).select("id", F.col("_b.id").alias("top")).checkpoint()
    while True:
        step = to.join(to.toDF("top", "_next"), "top").select("id", "top", "_next").checkpoint()
        to = step.select("id", F.col("_next").alias("top"))
        if not step.filter("top <> _next").limit(1).count():
            return to


def extrema(volume: DataFrame, threshold: float = float("-inf")) -> DataFrame:
    """(id, kind, size): maxima and minima above a threshold, and how many voxels run to each."""
    found = [manifolds(volume, rising).groupBy("top").agg(F.count("*").alias("size")).select(F.col("top").alias("id"), F.lit(kind).alias("kind"), "size") for rising, kind in ((True, "maximum"), (False, "minimum"))]
    return found[0].union(found[1]).join(volume.filter(F.col("value") > threshold).select("id"), "id", "left_semi")


# --- porosity ----------------------------------------------------------------------------------------------------------
def porosity(s: System, selection: DataFrame, steps: int = 512) -> DataFrame:
    """(frame, value): the share of the box about the atoms' spheres that lies in none; its longest edge is cut into ``steps``.

    A voxel is full if its centre lies in a sphere.  Each sphere gives an interval for each column of voxels that it meets,
    and the intervals of a column are joined, so that rows grow with the square of the steps and not with the cube.  Atoms
    are first moved next to their centre across periodic borders.  Without any full voxel the value is 0.
    """
    t = s.trajectory.join(selection.select("atom_idx"), "atom_idx", "left_semi").join(s.atoms.select("atom_idx", F.col("radius").alias("mass")), "atom_idx")
    centre = properties.prefixed(properties.com_periodic(t, s.cell), "c", ["frame"])
    near = {c: F.col(f"c{c}") + g.min_image(F.col(c) - F.col(f"c{c}"), n) for c, n in zip("xyz", s.cell, strict=True)}
    t = t.join(centre, "frame").withColumns(near).select("frame", "x", "y", "z", F.col("mass").alias("r"))
    box = t.groupBy("frame").agg(*[F.min(F.col(c) - F.col("r")).alias(f"l{c}") for c in "xyz"], *[F.greatest(F.lit(1.0), F.max(F.col(c) + F.col("r")) - F.min(F.col(c) - F.col("r"))).alias(f"e{c}") for c in "xyz"])
    box = box.withColumn("v", F.greatest("ex", "ey", "ez") / steps)
    box = box.withColumns({f"n{c}": F.ceil(F.round(F.col(f"e{c}") / F.col("v"), 9)) for c in "xyz"})
    t = t.join(box, "frame")

    def span(centre: Column, half: Column, c: str) -> tuple[Column, Column]:
        at = lambda p: (p - F.col(f"l{c}")) / F.col("v") - 0.5
        return F.greatest(F.lit(0), F.ceil(at(centre - half))), F.least(F.col(f"n{c}") - 1, F.floor(at(centre + half)))

    def exploded(df: DataFrame, half: Column, c: str) -> DataFrame:
        a, b = span(F.col(c), half, c)
        return df.withColumn(f"i{c}", F.explode(F.when(a <= b, F.sequence(a, b)))).withColumn(f"d{c}", F.col(f"l{c}") + (F.col(f"i{c}") + 0.5) * F.col("v") - F.col(c))

    t = exploded(t, F.col("r"), "x")
    t = exploded(t, F.sqrt(F.greatest(F.lit(0.0), F.col("r") * F.col("r") - F.col("dx") * F.col("dx"))), "y")
    a, b = span(F.col("z"), F.sqrt(F.greatest(F.lit(0.0), F.col("r") * F.col("r") - F.col("dx") * F.col("dx") - F.col("dy") * F.col("dy"))), "z")
    t = t.select("frame", "ix", "iy", a.alias("a"), b.alias("b")).filter("a <= b")
    before = Window.partitionBy("frame", "ix", "iy").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("b") - F.greatest(F.col("a"), F.coalesce(F.max("b").over(before) + 1, F.col("a"))) + 1)
    full = t.withColumn("_n", new).groupBy("frame").agg(F.sum("_n").alias("_full"))
    return box.join(full, "frame", "left").select("frame", F.coalesce(1.0 - F.col("_full") / (F.col("nx") * F.col("ny") * F.col("nz")), F.lit(0.0)).alias("value"))
