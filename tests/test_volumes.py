"""Orbitals, manifolds and porosity against versions in plain Python."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import volumes
from orrery.schema import System


@pytest.mark.parametrize(("coeff", "alpha", "powers"), [(1.0, 0.5, (0, 0, 0)), (-2.0, 1.5, (1, 0, 0)), (0.7, 0.3, (2, 1, 1)), (1e-9, 0.5, (1, 1, 0))])
def test_cutoff(spark, coeff, alpha, powers):
    df = spark.createDataFrame([(coeff, alpha, *powers)], "c double, a double, i int, j int, k int")
    r = df.select(volumes.cutoff_radius(F.col("c"), F.col("a"), F.col("i"), F.col("j"), F.col("k"), 1e-6)).first()[0]
    n = sum(powers)
    along = math.prod(math.sqrt(p / n) ** p if p else 1 for p in powers) if n else 1.0
    f = lambda d: abs(coeff) * along * d ** n * math.exp(-alpha * d * d)
    assert r == 0 and max(map(f, np.linspace(0.01, 9, 500))) < 1e-6 or f(r) == pytest.approx(1e-6, rel=1e-6) and f(r * 1.01) < 1e-6


def test_orbitals_on_a_grid(spark):
    o = [(0.3, 0.1, -0.2, 0.8, 0.6, 1, 0, 2, 2.5), (-3.0, 1.0, 0.5, -0.4, 0.3, 0, 0, 0, 1.5), (1.0, 1.0, 1.0, 5.0, 1.0, 0, 0, 0, 0.0)]
    orbitals = spark.createDataFrame(o, "x double, y double, z double, coeff double, alpha double, i int, j int, k int, cutoff double")
    points = volumes.grid(spark, (-4, -1, -1), 0.5, (17, 5, 6))
    assert points.count() == 510
    got = {r.point: r.value for r in volumes.evaluate(points, orbitals, squared=True).collect()}
    for p in points.collect():
        want = 0.0
        for x, y, z, c, a, i, j, k, cut in o:
            d = (p.x - x, p.y - y, p.z - z)
            r2 = sum(v * v for v in d)
            want += c * d[0] ** i * d[1] ** j * d[2] ** k * math.exp(-a * r2) if cut and r2 <= cut * cut else 0.0
        assert got[p.point] == pytest.approx(want * want, abs=1e-12)
    assert {r.value for r in volumes.evaluate(points, orbitals.limit(0)).collect()} == {0.0}


def test_manifolds_with_ties_and_nulls(spark):
    rows = [(x, x, 0, 0, v) for x, v in enumerate([1.0, 1.0, 1.0, None, 5.0, 3.0, float("nan"), 2.0])]
    v = spark.createDataFrame(rows, "id long, ix int, iy int, iz int, value double")
    assert dict(volumes.manifolds(v).collect()) == {0: 2, 1: 2, 2: 2, 4: 4, 5: 4, 7: 7}
    assert dict(volumes.manifolds(v, False).collect()) == {0: 0, 1: 0, 2: 0, 4: 5, 5: 5, 7: 7}
    assert sorted((r.id, r.kind, r["size"]) for r in volumes.extrema(v, 1.5).collect()) == [(4, "maximum", 2), (5, "minimum", 2), (7, "maximum", 1), (7, "minimum", 1)]
    assert not volumes.manifolds(v.limit(0)).count()


def test_porosity_of_overlapping_spheres(spark):
    at = [(1.0, 0.0, 0.0, 1.5), (9.5, 0.5, 0.0, 1.0), (2.5, 0.3, 0.4, 1.2)]  # the second lies across the border
    atoms = spark.createDataFrame([(i + 1, "C", "C", 6, 12.0, r, 0, 1) for i, (*_, r) in enumerate(at)], "atom_idx long, type string, element string, z int, mass double, radius double, flags int, comp_idx int")
    t = spark.createDataFrame([(0, i + 1, x, y, z) for i, (x, y, z, _) in enumerate(at)], "frame int, atom_idx long, x double, y double, z double")
    s = System(atoms, atoms, atoms, atoms, t, (10.0, 0.0, 0.0))
    p = np.array([(x - 10 if x > 9 else x, y, z) for x, y, z, _ in at])
    r = np.array([a[3] for a in at])
    low, ext = (p - r[:, None]).min(0), (p + r[:, None]).max(0) - (p - r[:, None]).min(0)
    v = ext.max() / 40
    n = np.ceil(np.round(ext / v, 9)).astype(int)
    c = np.stack(np.meshgrid(*[low[k] + (np.arange(n[k]) + 0.5) * v for k in range(3)], indexing="ij"), -1)
    solid = (((c[..., None, :] - p) ** 2).sum(-1) <= r ** 2).any(-1)
    assert volumes.porosity(s, atoms, 40).first().value == pytest.approx(1 - solid.mean(), abs=1e-4)
    assert not volumes.porosity(s, atoms.limit(0), 40).count()
