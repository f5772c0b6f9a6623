"""Structure told by names and bonds, on systems worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from orrery.functions import names
from orrery.operators import structure
from orrery.plans import language, script
from orrery.schema import System


@pytest.mark.parametrize(("label", "residue", "size", "want"), [
    ("OW", "HOH", 3, 8), ("CA", "ALA", 10, 6), ("CA", "CA", 1, 20), ("", "NA", 1, 11), ("1HB", "LYS", 20, 1), ("Cl1", "LIG", 30, 17), ("CL1", "LIG", 30, 6), ("CL12", "", 1, 17), ("", "", 1, 0), (None, None, None, 0), ("Q", "LIG", 9, 0),
])
def test_element_of_label(spark, label, residue, size, want):
    df = spark.createDataFrame([(label, residue, size)], "l string, r string, n int")
    assert df.select(names.z_of_label(F.col("l"), F.col("r"), F.col("n"))).first()[0] == want


def test_element_of_mass(spark):
    df = spark.createDataFrame([(1.008,), (12.011,), (1.0,), (207.2015,), (500.0,), (None,)], "m double")
    assert [r[0] for r in df.select(names.z_of_mass(F.col("m"))).collect()] == [1, 6, 0, 82, 0, 0]


def test_chain_ids(spark):
    want = {0: "A", 25: "Z", 26: "AA", 51: "AZ", 52: "BA", 701: "ZZ", 702: "AAA"}
    df = spark.createDataFrame([(k,) for k in want], "k int")
    assert dict(df.select("k", names.chain_id(F.col("k"))).collect()) == want


def _system(spark, bonds, n, types=None, flags=0):
    types = types or ["C"] * n
    atoms = spark.createDataFrame([(i + 1, t, t[0], 6, 12.0, 1.7, 0, 1) for i, t in enumerate(types)], "atom_idx long, type string, element string, z int, mass double, radius double, flags int, comp_idx int")
    components = spark.createDataFrame([(1, "LIG", 1, flags, 1)], "comp_idx int, name string, seq_id int, flags int, inst_idx int")
    instances = spark.createDataFrame([(1, "A", "A", 2)], "inst_idx int, id string, auth_id string, flags int")
    at = spark.createDataFrame([(0, i + 1, float(i * 3 % 10), 0.0, 0.0) for i in range(n)], "frame int, atom_idx long, x double, y double, z double")
    return System(atoms, components, instances, spark.createDataFrame(bonds, "i long, j long"), at, (10.0, 0.0, 0.0))


def test_fused_rings(spark):
    # two hexagons that share the bond 1-6: their common outline has ten atoms and is no ring
    bonds = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 1), (6, 7), (7, 8), (8, 9), (9, 10), (10, 1)]
    found = sorted(tuple(r.ring) for r in structure.rings(_system(spark, bonds, 10)).collect())
    assert found == [(1, 2, 3, 4, 5, 6), (1, 6, 7, 8, 9, 10)]
    assert not structure.rings(_system(spark, bonds, 10, flags=0x20000)).count()
    assert not structure.rings(_system(spark, [(1, 2), (2, 2)], 2)).count()
    groups = structure.ring_atoms(_system(spark, bonds, 10)).groupBy("group_id").count().collect()
    assert sorted(r["count"] for r in groups) == [6, 6]


def test_unwrap_chain(spark):
    # each atom lies three along from the last, wrapped at ten
    rows = structure.unwrap(_system(spark, [(i, i + 1) for i in range(1, 9)], 9)).orderBy("atom_idx").collect()
    assert [r.x for r in rows] == [3.0 * i for i in range(9)]


def test_nucleic_atoms(spark):
    s = _system(spark, [], 6, ["O5'", "C5'", "C4'", "C3'", "O3'", "N1"])
    assert [tuple(r) for r in structure.nucleic_atoms(s).collect()] == [(1, None, 1, 2, 3, 4, 5)]
    assert not structure.amino_atoms(s).count()


def test_bond_edits(spark):
    b = spark.createDataFrame([(1, 2), (3, 2)], "i long, j long")
    more = spark.createDataFrame([(2, 1), (4, 4), (5, 4)], "i long, j long")
    assert sorted(map(tuple, structure.insert_bonds(b, more).collect())) == [(1, 2), (2, 3), (4, 5)]
    assert [tuple(r) for r in structure.remove_bonds(b, more).collect()] == [(2, 3)]
    assert structure.find_bond(b, 2, 3).count() == 1 and structure.find_bond(b, 1, 3).count() == 0


def test_numbered(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000 / 10).cast("int").alias("k"), "id")
    rows = structure.numbered(df, "k", "id").orderBy("position").collect()
    assert [r.position for r in rows] == list(range(1000)) and [(r.k, r.id) for r in rows] == sorted((r.k, r.id) for r in rows)


def test_rings_in_the_language(spark):
    s = _system(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 7), (7, 4), (7, 8)], 8)
    groups: dict[int, set] = {}
    for r in language.select(s, "ring").collect():
        groups.setdefault(r.group_id, set()).add(r.atom_idx)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3], [4, 5, 6, 7]]
    assert {r.atom_idx for r in language.filter_atoms(s, "not ring").collect()} == {8}
    assert {r.atom_idx for r in language.filter_atoms(s, "ring and atom(3:8)").collect()} == {3, 4, 5, 6, 7}
    assert script.table(script.run(s, "v = count(ring)")["v"], spark).first()["value"] == 7


def test_porosity_of_a_script_and_whole_systems(spark):
    s = _system(spark, [(i, i + 1) for i in range(1, 9)], 9)
    one = script.table(script.run(s, "v = porosity(atom(1))")["v"], spark).first()["value"]
    assert one == pytest.approx(1 - 3.141592653589793 / 6, abs=1e-4)
    assert [r.x for r in structure.whole(s).trajectory.orderBy("atom_idx").collect()] == [3.0 * i for i in range(9)]
    with pytest.raises(language.LanguageError):
        script.run(s, "v = porosity(all) in residue(:)")
