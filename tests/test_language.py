"""Expressions of the selection language against sets worked out by hand, and the text formats."""

from __future__ import annotations

import pytest

from orrery.plans import language
from orrery.schema import System
from orrery.sources import sinks, text


@pytest.fixture(scope="module")
def system(spark):
    # fixed values: the atoms of the small system and their types
    types = {"H1": ("H", 1), "HE": ("He", 2), "CA": ("C", 6), "N": ("N", 7), "O": ("O", 8)}
    of, comp = "H1 O H1 HE CA O CA O H1 O H1 HE CA N CA O".split(), [1] * 3 + [2] * 5 + [3] * 4 + [4] * 4
    atoms = spark.createDataFrame([(i + 1, t, *types[t], 1.0, 1.0, 0x4 if t == "CA" else 0, c) for i, (t, c) in enumerate(zip(of, comp, strict=True))],
                                  "atom_idx long, type string, element string, z int, mass double, radius double, flags int, comp_idx int")
    components = spark.createDataFrame([(1, "SOL", 1, 0x20000, 1), (2, "LYS", 2, 0x200, 2), (3, "PFT", 3, 0, 3), (4, "PFT", 4, 0, 3)], "comp_idx int, name string, seq_id int, flags int, inst_idx int")
    instances = spark.createDataFrame([(1, "A", "X", 0), (2, "B", "Y", 2), (3, "C", "Z", 2)], "inst_idx int, id string, auth_id string, flags int")
    bonds = spark.createDataFrame([(1, 2)], "i long, j long")
    at = spark.createDataFrame([(0, i + 1, float(i % 8 + 1), 0.0, 0.0) for i in range(16)], "frame int, atom_idx long, x double, y double, z double")
    return System(atoms, components, instances, bonds, at)


@pytest.mark.parametrize(("expression", "bits"), [
    ("all", "1111111111111111"), ("resname('SOL')", "1110000000000000"), ("resname('LYS')", "0001111100000000"), ("element('C')", "0000101000001010"), ("label('CA')", "0000101000001010"),
    ("atom(1) in resname('PFT')", "0000000010001000"), ("atom(1:2:8)", "1010101000000000"), ("atom(2:3:16)", "0100100100100100"), ("element(1:2:10)", "1010000010100100"),
    ("residue(1:2:4)", "1110000011110000"), ("not resname('P*')", "1111111100000000"), ("backbone and residue(2)", "0000101000000000"), ("water or atom(4, 5)", "1111100000000000"),
    ("atom(1:4) xor atom(3:6)", "1100110000000000"), ("chain('B') or auth_id('X')", "1111111100000000"), ("residue(atom(9))", "0000000011110000"), ("within_x(7:)", "0000001100000011"),
    ("within(1.0, atom(1))", "0100000011000000"), ("flatten(residue(3:4)) and type('*E', 'N')", "0000000000010100"), ("atom(1) in (element('O') in resname('PFT'))", "0000000001000001"),
])
def test_selects(system, expression, bits):
    got = {r.atom_idx for r in language.filter_atoms(system, expression).collect()}
    assert "".join("1" if i + 1 in got else "0" for i in range(16)) == bits


@pytest.mark.parametrize("expression", ["residue(1:0:5)", "residue(5:2:1)", "resname('ALA') resname('GLY')", "nothing(1)", "atom(", "not", "3 and all", "atom(1) @", "within_x(3)"])
def test_refuses(system, expression):
    with pytest.raises(language.LanguageError):
        language.filter_atoms(system, expression)


def test_formats(spark, tmp_path):
    (tmp_path / "a.gro").write_text("title\n2\n    1SOL     OW    1   0.100   0.200   0.300\n    1SOL    HW1    2   1.100   1.200   1.300\n   2.0 2.0 2.0\n")
    rows = text.read_gro(spark, f"{tmp_path}/a.gro").orderBy("atom_idx").collect()
    assert [(r.atom_idx, r.res_name, r.atom_name, round(r.x, 3), round(r.z, 3)) for r in rows] == [(1, "SOL", "OW", 1.0, 3.0), (2, "SOL", "HW1", 11.0, 13.0)]
    (tmp_path / "a.xyz").write_text("2\none\nC 0 1 2\nH 3 4 5\n2\ntwo\nC 6 7 8\nH 9 1 2\n")
    assert [(r.model, r.element, r.x) for r in text.read_xyz(spark, f"{tmp_path}/a.xyz").orderBy("model", "atom_idx").collect()] == [(0, "C", 0.0), (0, "H", 3.0), (1, "C", 6.0), (1, "H", 9.0)]
    (tmp_path / "a.xvg").write_text('# c\n@ title "t"\n@ s0 legend "E"\n0.0 1.5\n1.0 -2\n')
    assert [r["values"] for r in text.read_xvg(spark, f"{tmp_path}/a.xvg").orderBy("row").collect()] == [[0.0, 1.5], [1.0, -2.0]]
    assert text.read_xvg_legends(spark, f"{tmp_path}/a.xvg").first()["legend"] == "E"
    (tmp_path / "a.csv").write_text("t,v\n0,1\n1,2.5\n")
    assert [(r.row, r.name, r.value) for r in text.read_table(spark, f"{tmp_path}/a.csv").orderBy("row", "name").collect()] == [(0, "t", 0.0), (0, "v", 1.0), (1, "t", 1.0), (1, "v", 2.5)]
    atom = "ATOM      1  CA  GLY A   7      11.104   6.134  -6.504  1.00  0.00           C"
    (tmp_path / "a.pdb").write_text(f"CRYST1   50.000   60.000   70.000  90.00  90.00  90.00\nMODEL        1\n{atom}\nENDMDL\nMODEL        2\n{atom}\nENDMDL\n")
    atoms = text.read_pdb(spark, f"{tmp_path}/a.pdb")
    assert [(r.model, r.name, r.res_seq, r.y, r.element) for r in atoms.orderBy("model").collect()] == [(1, "CA", 7, 6.134, "C"), (2, "CA", 7, 6.134, "C")]
    assert text.read_pdb_cell(spark, f"{tmp_path}/a.pdb").first()["b"] == 60.0
    assert sinks.pdb_lines(atoms).first()["value"] == atom
