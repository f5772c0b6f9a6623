"""Reductions over pairs of points against all pairs, one by one; and that no plan makes those pairs as rows."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from orrery.functions import geometry as g
from orrery.operators import pairs, properties, structure
from orrery.plans import catalog, script
from orrery.schema import System

CELL = (10.0, 10.0, 0.0)
DATA = "/root/testdata/sf0.001"


def _cloud(n: int, seed: int, frames: int = 2):
    r = random.Random(seed)
    return [(f, i, *(r.uniform(-14, 14) for _ in range(2)), r.uniform(-3, 3)) for f in range(frames) for i in range(1, n + 1)]


def _d2(p, q, cell=CELL):
    return sum((d - n * round(d / n) if n else d) ** 2 for d, n in ((b - a, n) for a, b, n in zip(p[2:5], q[2:5], cell, strict=True)))


def _frame(spark, rows):
    return spark.createDataFrame(rows, "frame int, atom_idx long, x double, y double, z double")


def _system(spark, rows, z=(6, 8), bonds=(), cell=CELL):
    n = max(r[1] for r in rows)
    atoms = spark.createDataFrame([(i, "C", "C", z[i % len(z)], 12.0, 1.7 if i % 2 else 1.2, 0, i % 3 + 1) for i in range(1, n + 1)], "atom_idx long, type string, element string, z int, mass double, radius double, flags int, comp_idx int")
    components = spark.createDataFrame([(c, "SOL", c, 0x20000 if c == 3 else 0, 1) for c in (1, 2, 3)], "comp_idx int, name string, seq_id int, flags int, inst_idx int")
    instances = spark.createDataFrame([(1, "A", "A", 0)], "inst_idx int, id string, auth_id string, flags int")
    return System(atoms, components, instances, spark.createDataFrame(list(bonds), "i long, j long"), _frame(spark, rows), cell)


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_min_image_rounds_as_sql(spark):
    """Halves go away from 0, and what is just below a half goes down."""
    xs = [0.5, -0.5, 1.5, -1.5, 2.5, -2.5, 0.49999999999999994, -0.49999999999999994, 0.0, 3.2, -3.7]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(g.nearest(g.F.col("x"))).collect()]
    assert got == [1, -1, 2, -2, 3, -3, 0, 0, 0, 3, -4]


def test_covalent_bonds(spark):
    """With metals and water, in a cell of two periods; judged where they are made, so there is no join of the pairs."""
    rows, z = _cloud(90, 1, 1), (6, 8, 26, 11, 7)
    s = _system(spark, rows, z)
    radius, water = (lambda i: 1.7 if i % 2 else 1.2), (lambda i: i % 3 + 1 == 3)

    def bonded(p, q):
        i, j = p[1], q[1]
        zi, zj, total, d = z[i % 5], z[j % 5], radius(i) + radius(j), _d2(p, q) ** 0.5
        a, b = zi in (26, 11), zj in (26, 11)
        if not a and not b:
            high = total * 1.15 * (1.05 if i % 3 == j % 3 else 1.0)
        elif a != b:
            high = total * 1.30 if (zj if a else zi) in properties.DONORS and not water(i) and not water(j) else 0
        else:
            high = total * 0.90 if zi == zj == 26 else 0
        return total * 0.65 < d < high

    found = properties.covalent_bonds(s)
    assert sorted(map(tuple, found.collect())) == [(p[1], q[1]) for p in rows for q in rows if p[1] < q[1] and bonded(p, q)]
    assert _plan(found).count("Join") <= 4 and "FlatMapGroupsInArrow" in _plan(found)


@pytest.mark.parametrize("cell", [CELL, (0.0, 0.0, 0.0), (10.0, 7.0, 30.0)])
@pytest.mark.parametrize("largest", [False, True])
def test_extreme(spark, cell, largest):
    rows = _cloud(150, 2)
    a, b = ([r for r in rows if (r[1] % 3 == 0) == side] for side in (True, False))
    want = {f: (max if largest else min)(_d2(p, q, cell) for p in a for q in b if p[0] == q[0] == f) ** 0.5 for f in (0, 1)}
    got = dict(map(tuple, pairs.extreme(_frame(spark, a), _frame(spark, b), cell, largest).collect()))
    assert got == pytest.approx(want, abs=1e-12)


def test_extremes_make_no_pairs(spark):
    for name in ("distance_max_whole", "distance_min_whole"):
        assert "CoGroup" in _plan(catalog.QUERIES[name](spark, DATA)), name


def test_distance_pairs_in_parts(spark):
    """The pairs of a frame are dealt out, not made by one task."""
    rows = _cloud(30, 3)
    a, b = _frame(spark, rows[:20]), _frame(spark, rows[20:])
    one, many = (sorted(map(tuple, properties.distance_pairs(a, b, CELL, n).collect())) for n in (1, 16))
    assert one == many and len(one) == sum(p[0] == q[0] for p in rows[:20] for q in rows[20:])
    assert "_part" in _plan(catalog.QUERIES["distance_pair_whole"](spark, DATA))


@pytest.mark.parametrize("cell", [CELL, (0.0, 0.0, 0.0), (10.0, 7.0, 30.0), (4.0, 4.0, 4.0)])
@pytest.mark.parametrize("cutoff", [1.0, 3.3])
def test_count_pairs(spark, cell, cutoff):
    rows = _cloud(120, 4) + [(2, 1, 0.0, 0.0, 0.0), (2, 2, 0.0, 0.0, cutoff)]
    want = Counter(p[0] for p in rows for q in rows if p[0] == q[0] and p[1] < q[1] and _d2(p, q, cell) <= cutoff * cutoff)
    assert dict(map(tuple, pairs.count_pairs(_frame(spark, rows), cutoff, cell).collect())) == want


def test_script_extreme_of_pairs(spark):
    """The least of all distances needs no rows of them; what is done with rows still has them."""
    s = _system(spark, _cloud(40, 5))
    v = script.run(s, "d = distance_pair(atom(1:10), atom(11:40)); a = min(d); b = max(d); c = min(d * 2);")
    a, b, c = (dict((r.frame, r.value) for r in script.table(v[n]).collect()) for n in "abc")
    d = script.table(v["d"]).collect()
    assert len(d) == 2 * 10 * 30
    for f in (0, 1):
        each = [r.value for r in d if r.frame == f]
        assert (a[f], b[f], c[f]) == pytest.approx((min(each), max(each), 2 * min(each)), abs=1e-12)
    assert "CoGroup" in _plan(script.table(v["a"])) and "CoGroup" not in _plan(script.table(v["c"]))


def test_hydrogen_bonds(spark):
    """Against all donors, hydrogens and acceptors; ties and what an acceptor has no room for as told."""
    import math

    rows = _cloud(80, 6)
    z = (7, 1, 8, 6)  # of atoms 4 k, 4 k + 1, 4 k + 2, 4 k + 3
    bonds = [(i, i + 1) for i in range(4, 77, 4)]
    s = _system(spark, rows, z, bonds)
    at = {r[:2]: r for r in rows}
    image = lambda p, q: [d - n * round(d / n) if n else d for d, n in ((b - a, n) for a, b, n in zip(p[2:5], q[2:5], CELL, strict=True))]
    best = {}
    for f in (0, 1):
        for i, h in bonds:
            found = []
            for k in range(1, 81):
                if z[k % 4] in (7, 8) and k != i and _d2(at[f, i], at[f, k]) <= 25.0:
                    u, v = image(at[f, h], at[f, i]), image(at[f, h], at[f, k])
                    far = math.hypot(*v)
                    angle = math.acos(max(-1.0, min(1.0, sum(a * b for a, b in zip(u, v, strict=True)) / (math.hypot(*u) * far))))
                    if angle > math.radians(120):
                        found.append((-round(math.cos(math.pi - angle) / far, 9), k))
            if found:
                score, k = min(found)
                best.setdefault((f, k), []).append((score, h, i))
    want = sorted((f, i, h, k, -score) for (f, k), rows in best.items() for score, h, i in sorted(rows)[:2])
    got = structure.hydrogen_bonds(s, 5.0, 120.0)
    found = sorted(map(tuple, got.collect()))
    assert [r[:4] for r in found] == [r[:4] for r in want] and want
    assert [r[4] for r in found] == pytest.approx([r[4] for r in want], abs=2e-9)
    assert "CoGroup" in _plan(got)


@pytest.mark.parametrize("low", [0.0, 2.0])
def test_rdf(spark, low):
    """Distances count as rounded, as in the SQL: also one that is rounded down to the last."""
    rows = _cloud(100, 7) + [(2, 1, 0.0, 0.0, 0.0), (2, 2, 0.0, 0.0, 4.0000000002)]
    a, b = ([r for r in rows if (r[1] % 2 == 0) == side] for side in (True, False))
    d = [(p[0], round(_d2(p, q) ** 0.5, 9)) for p in a for q in b if p[0] == q[0]]
    start, width = max(low, 1e-3), (4.0 - low) / 64
    want = Counter((f, min(int((x - start) / width), 63)) for f, x in d if start <= x <= 4.0)
    assert want[2, 63] == 1
    assert {(r.frame, r.bin): r.n for r in properties.rdf(_frame(spark, a), _frame(spark, b), CELL, 4.0, low, 64).collect()} == want


@pytest.mark.parametrize("name", ["rdf_weights", "script_field_arith"])
def test_weighted_rdf_counts_once(spark, name):
    """Weights come from the counts of the same pass over the pairs."""
    assert _plan(catalog.QUERIES[name](spark, DATA)).count("CoGroup") == 1


def test_contacts(spark):
    """By group, without shared atoms and those some bonds away from them; the plan grows with the hops, not with their power."""
    rows, bonds = _cloud(100, 8), [(i, i + 1) for i in range(1, 60)]
    s = _system(spark, rows, bonds=bonds)
    groups = {1: set(range(1, 21)), 2: set(range(15, 41))}
    second = set(range(18, 24)) | set(range(60, 100))
    a = _frame(spark, rows).join(spark.createDataFrame([(k, i) for k, v in groups.items() for i in v], "group_id long, atom_idx long"), "atom_idx")
    b = _frame(spark, [r for r in rows if r[1] in second])
    want = Counter()
    for k, own in groups.items():
        out = own & second
        for _ in range(2):
            out |= {j for i in out for p in bonds if i in p for j in p}
        for p in rows:
            if p[1] in own:
                want[p[0], k] += sum(q[0] == p[0] and q[1] in second - out - {p[1]} and _d2(p, q) <= 9.0 for q in rows)
    found = properties.contacts(s, a, b, 3.0, 2)
    assert {(r.frame, r.group_id): r.n for r in found.collect()} == {k: n for k, n in want.items() if n}
    assert len(_plan(properties.contacts(s, a, b, 3.0, 8))) < 4 * len(_plan(properties.contacts(s, a, b, 3.0, 4)))
