"""Files of systems, written here, as their readers see them."""

from __future__ import annotations

import pytest

from orrery.sources import text, topology

CIF = """data_T
# a comment
_cell.length_a 10.5
_struct.title 'It''s "one" isn't two'
_struct.note
;first
second
;
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.type_symbol
_atom_site.label_atom_id
_atom_site.label_alt_id
_atom_site.label_comp_id
_atom_site.label_asym_id
_atom_site.label_entity_id
_atom_site.label_seq_id
_atom_site.auth_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
ATOM 1 N N . ALA A 1 1 5 1.0 2.0 3.0
ATOM 2 C CA A ALA A 1 1 5 1.5 2.5 3.5
ATOM 3 C CA B ALA A 1 1 5 9 9 9
HETATM 4 O "O5'" . HOH B 2 . 7 4 5 6
#
_last.item x
"""


def test_mmcif(spark, tmp_path):
    (tmp_path / "a.cif").write_text(CIF)
    items = {(r.category, r.item): r.value for r in topology.read_cif(spark, str(tmp_path)).filter("category <> 'atom_site'").collect()}
    assert items[("cell", "length_a")] == "10.5" and items[("struct", "note")] == "first\nsecond" and items[("last", "item")] == "x"
    rows = topology.read_mmcif(spark, str(tmp_path)).orderBy("serial").collect()
    assert [(r.serial, r.name, r.res_seq, r.x, r.is_hetatm) for r in rows] == [(1, "N", 1, 1.0, False), (2, "CA", 1, 1.5, False), (4, "O5'", 7, 4.0, True)]
    numbered = topology.number_components(topology.read_mmcif(spark, str(tmp_path))).orderBy("atom_idx").collect()
    assert [(r.atom_idx, r.comp_idx, r.inst_idx, r.element) for r in numbered] == [(1, 1, 1, "N"), (2, 1, 1, "C"), (3, 2, 2, "O")]


DATA = """title

3 atoms
2 bonds
2 atom types
-1 9 xlo xhi
0 10 ylo yhi
2 12 zlo zhi
1.5 0 0 xy xz yz

Masses

1 15.999 # oxygen
2 1.008

Pair Coeffs

1 0.2 3.0
2 0.1 2.0

Atoms{style}

1 7 1 -0.8 0 0 2 0 0 1
3 7 2 0.4 2.5 1 4 0 0 0
2 7 2 0.4 1 1 3 0 0 0

Bonds

1 1 2 1
2 1 1 3
"""


@pytest.mark.parametrize("style", ["  # full", ""])
def test_lammps_data(spark, tmp_path, style):
    (tmp_path / "a.data").write_text(DATA.format(style=style))
    d = topology.read_lammps_data(spark, str(tmp_path))
    rows = d["atoms"].orderBy("atom_idx").collect()
    assert [(r.atom_idx, r.type, r.element, r.comp_idx, r.x, r.y, r.z) for r in rows] == [(1, "type_1", "O", 7, 1, 0, 0), (2, "type_2", "H", 7, 2, 1, 1), (3, "type_2", "H", 7, 3.5, 1, 2)]
    assert sorted((r.i, r.j) for r in d["bonds"].collect()) == [(1, 2), (1, 3)]
    c = d["cell"].first()
    assert (c.lx, c.ly, c.lz, c.xy, c.yz) == (10, 10, 10, 1.5, 0)
    assert {r.type_id: round(r.radius, 6) for r in topology.lammps_radii(spark, str(tmp_path)).collect()} == {1: round(3 * 2 ** (1 / 6) / 2, 6), 2: round(2 ** (1 / 6), 6)}


def test_styles():
    assert topology.detect_style("", "1 1 0.5 0.5 0.5".split()) == "atomic" and topology.detect_style("", "1 1 -0.2 0.5 0.5 1".split()) == "charge"
    assert topology.detect_style("", "1 1 2 0.5 0.5 1.0 0 0 0".split()) == "molecular" and topology.detect_style("molecular hybrid", []) == "molecular"
    with pytest.raises(ValueError):
        topology.detect_style("", "1 2 3".split())


@pytest.mark.parametrize(("count", "more"), [("1", ""), ("-1", "2 5 6\n"), ("1", None)])
def test_cube(spark, tmp_path, count, more):
    m = 2 if count == "-1" else 1
    values = " ".join(f"{v / 2:.5E}" + ("\n" if v % 6 == 5 else "") for v in range(12 * m))
    (tmp_path / "a.cube").write_text(f"title\nnote\n{count} 0 0 1.0\n2 1.0 0 0\n3 0 1.0 0\n2 0 0 1.0\n8 8.0 1.0 2.0 3.0\n{more or ''}{values if more is not None else '1 2 3'}\n")
    grid, atoms, v = topology.read_cube(spark, str(tmp_path))
    if more is None:
        with pytest.raises(Exception, match="too few"):
            v.collect()
        return
    g, a = grid.first(), atoms.first()
    assert g.counts == [2, 3, 2] and g.origin[2] == pytest.approx(0.529177210903) and (a.atomic, a.charge) == (8, 8.0) and a.y == pytest.approx(1.058354, abs=1e-6)
    got = {(r.ix, r.iy, r.iz, r.m): r.value for r in v.collect()}
    assert got == {(x, y, z, k): (((x * 3 + y) * 2 + z) * m + k) / 2 for x in range(2) for y in range(3) for z in range(2) for k in range(m)}


def test_xyz_kinds(spark, tmp_path):
    atoms = "C 0 0 0\nH 1 0 0\n"
    (tmp_path / "a.xyz").write_text(f'2\nLattice="5 0 0 0 6 0 0 0 7" Properties=species:S:1:pos:R:3\n{atoms}2\nnote\n{atoms}2\n5 6 7 90 90 90\n{atoms}')
    rows = topology.read_xyz_cells(spark, str(tmp_path)).orderBy("model").collect()
    assert [(r.kind, r.cell and len(r.cell)) for r in rows] == [("extended", 9), ("plain", None), ("arc", 6)] and rows[0].cell[4] == 6.0
    assert text.read_xyz(spark, str(tmp_path)).count() == 6


@pytest.mark.parametrize("decimals", [3, 5])
def test_gro_frames(spark, tmp_path, decimals):
    line = lambda i, x: f"{1:5d}SOL  {'OW':>5}{i:5d}" + "".join(f"{v:{decimals + 5}.{decimals}f}" for v in (x, -x, 10.5)) + "\n"
    frame = lambda x: f"t= {x}\n2\n{line(1, x)}{line(2, x + 1)}3.0 4.0 5.0\n"
    (tmp_path / "a.gro").write_text(frame(1.25) + frame(2.5))
    atoms, boxes = topology.read_gro_frames(spark, str(tmp_path))
    assert [(r.frame, r.atom_idx, r.x, r.y, r.z) for r in atoms.orderBy("frame", "atom_idx").collect()] == [(0, 1, 12.5, -12.5, 105), (0, 2, 22.5, -22.5, 105), (1, 1, 25, -25, 105), (1, 2, 35, -35, 105)]
    assert [(r.frame, r.title, r.box) for r in boxes.orderBy("frame").collect()] == [(0, "t= 1.25", [30, 40, 50]), (1, "t= 2.5", [30, 40, 50])]


def test_pdb_parts(spark, tmp_path):
    (tmp_path / "a.pdb").write_text("HELIX    1   1 ALA A    5  GLY A   14  1                                  10\nSHEET    1   A 2 VAL B  20  LEU B  27  0\n"
                                    "ATOM      1  N   ALA A   5       1.000   2.000   3.000  1.00  0.00\nATOM      2  CA AALA A   5       1.000   2.000   3.000  1.00  0.00\nATOM      3  CA BALA A   5       1.000   2.000   3.000  1.00  0.00\n"
                                    "HETATM    4 ZN    ZN B   6       1.000   2.000   3.000  1.00  0.00\nCONECT    1    2    3\nCONECT    2    1\n")
    assert sorted((r.i, r.j) for r in topology.read_pdb_connections(spark, str(tmp_path)).collect()) == [(1, 2), (1, 3)]
    found = topology.read_pdb_structure(spark, str(tmp_path)).orderBy("kind").collect()
    assert [(r.kind, r.first_chain, r.first, r.last_chain, r.last) for r in found] == [("helix", "A", 5, "A", 14), ("sheet", "B", 20, "B", 27)]
    rows = topology.number_components(text.read_pdb(spark, str(tmp_path))).orderBy("atom_idx").collect()
    assert [(r.serial, r.comp_idx, r.inst_idx, r.element) for r in rows] == [(1, 1, 1, "N"), (2, 1, 1, "C"), (4, 2, 2, "Zn")]
