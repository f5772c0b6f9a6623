"""Scripts over a small system: values, shapes and properties worked out by hand, and what must be refused."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from orrery.functions import geometry as g
from orrery.functions import strings, units
from orrery.operators import properties, spatial, superposition
from orrery.plans import language, script
from orrery.schema import System


@pytest.fixture(scope="module")
def system(spark):
    # fixed values: the atoms of the small system, their types and places
    types = {"H1": ("H", 1, 1.008, 1.2), "HE": ("He", 2, 4.002602, 1.4), "CA": ("C", 6, 12.011, 1.7), "N": ("N", 7, 14.007, 1.55), "O": ("O", 8, 15.999, 1.52)}
    of, comp = "H1 O H1 HE CA O CA O H1 O H1 HE CA N CA O".split(), [1] * 3 + [2] * 5 + [3] * 4 + [4] * 4
    xyz = [(1, 4, 3), (2, 3, 2), (3, 2, 1), (4, 1, 4), (5, 4, 3), (6, 3, 2), (7, 2, 1), (8, 1, 2), (1, 1, 2), (2, 1, 2), (3, 1, 2), (4, 1, 2), (5, 1, 2), (6, 1, 2), (7, 1, 2), (8, 1, 2)]
    atoms = spark.createDataFrame([(i + 1, t, *types[t], 0x4 if t == "CA" else 0, c) for i, (t, c) in enumerate(zip(of, comp, strict=True))],
                                  "atom_idx long, type string, element string, z int, mass double, radius double, flags int, comp_idx int")
    components = spark.createDataFrame([(1, "SOL", 1, 0x20000, 1), (2, "LYS", 2, 0x200, 2), (3, "PFT", 3, 0x1000, 3), (4, "PFT", 4, 0x800, 4)], "comp_idx int, name string, seq_id int, flags int, inst_idx int")
    instances = spark.createDataFrame([(1, "A", "X", 2), (2, "B", "Y", 0), (3, "C", "Z", 2), (4, "D", "Z", 2)], "inst_idx int, id string, auth_id string, flags int")
    bonds = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (5, 6)], "i long, j long")
    at = spark.createDataFrame([(f, i + 1, float(x + f), float(y), float(z)) for f in (0, 1) for i, (x, y, z) in enumerate(xyz)], "frame int, atom_idx long, x double, y double, z double")
    return System(atoms, components, instances, bonds, at)


def _one(spark, v):
    return script.table(v, spark).first()["value"]


@pytest.mark.parametrize(("text", "want"), [
    ("2 + 5", 7), ("2 + 5.0", 7.0), ("{2,1} + {1,8}", [3, 9]), ("{2.5,1.5} + {1.0,8.0}", [3.5, 9.5]), ("7 - 4 + 2 - 3", 2), ("vec3(2.5,1.5,1.0) + vec3(1.0,8.0,2.0)", [3.5, 9.5, 3.0]),
    ("-{1, 2} * 3", [-3, -6]), ("7 // 2", 3), ("-7 // 2", -3), ("7 / 2", 3.5), ("{1.0, 2} < 1.5", [True, False]), ("2 > {1, 3}", [True, False]), ("not (1 < 2) or 2 < 3", True), ("1 < 2 xor 2 < 3", False),
    ("{1,2,3}[2]", 2), ("{1,2,3,4,5}[1:2:5]", [1, 3, 5]), ("{{1,2},{3,4}}[:,1]", [1, 3]), ("{{1,2},{3,4},{5,6}}[2:3,2]", [4, 6]), ("transpose({{1,2},{3,4},{5,6}})", [[1, 3, 5], [2, 4, 6]]), ("flatten({{1,2},{3,4}})", [1, 2, 3, 4]),
    ("sqrt(16.0) + cbrt(8) + abs(-3)", 9.0), ("floor(2.5) + ceil(2.5)", 5.0), ("abs({-1.5, 2})", [1.5, 2.0]), ("floor({1.5, -1.5})", [1.0, -2.0]), ("ceil({1.5, -1.5})", [2.0, -1.0]), ("cos(0.0) + sin(0.0)", 1.0),
    ("asin(1.0) * 2 - PI", 0.0), ("acos(1.0) + atan(0.0) + atan(0.0, 1.0) + atan2(0.0, 1.0)", 0.0), ("log(E) + log2(8) + log10(100) + exp(0) + exp2(3)", 15.0), ("pow(2, 10)", 1024.0), ("min(2, 3) + max(2, 3)", 5),
    ("min({3, 1, 2}) + max({3, 1, 2})", 4), ("dot({1.0, 2, 3}, {4.0, 5, 6})", 32.0), ("cross(vec3(1,0,0), vec3(0,1,0))", [0.0, 0.0, 1.0]), ("length({3.0, 4.0})", 5.0), ("normalize({3.0, 4.0})", [0.6, 0.8]),
    ("mul({{1.0,2},{3,4}}, {1.0, 1})", [3.0, 7.0]), ("mul({{1.0,2},{3,4}}, {{0.0,1},{1,0}})", [[2.0, 1.0], [4.0, 3.0]]), ("vec2(1, 2)", [1.0, 2.0]), ("vec4(1, 2, 3, 4)", [1.0, 2.0, 3.0, 4.0]), ("{1, 2.5}", [1.0, 2.5]),
    ("5 - {1, 2}", [4, 3]), ("6.0 / {2.0, 3.0}", [3.0, 2.0]), ("1 == 1 and 1 != 2 and 1 <= 1 and 2 >= 1", True), ("float(2) + int(2.7)", 4.0), ("1.0 / 0", math.inf), ("2 * 3 + 4 * 5 # a comment", 26),
])
def test_values(spark, system, text, want):
    got = _one(spark, script.run(system, f"v = {text}")["v"])
    flat = lambda x: [y for z in x for y in flat(z)] if isinstance(x, list) else [x]
    assert type(got) is type(want) and flat(got) == pytest.approx(flat(want))


@pytest.mark.parametrize(("text", "n", "width"), [
    ("coord(1) in residue(:)", 4, 3), ("angle(1,2,3) in residue(:)", 4, None), ("{angle(1,2,3), angle(3,2,1)} in residue(:)", 4, 2), ("coord(1:2:5)", 3, 3), ("(coord(1) in residue(:))[:,1]", 4, None), ("coord(:)[2,2:]", None, 2),
    ("flatten(coord(1:15))", 45, None), ("transpose(coord(1:15))", 3, 15), ("shape_weights(residue(1:4))", 4, 3), ("coord(1:8)[1:2:7,1]", 4, None), ("distance_pair(1:3, 4:5)", 6, None), ("coord_xy(1:4)", 4, 2), ("coord_z(1:4)", 4, None),
    ("distance_pair(com(resname('LYS')), 1)", 1, None), ("plane(1:5)", None, 4), ("{coord_x(1:2), coord_x(3:5)}", 5, None), ("(com(:) in residue(:)) - com(all)", 4, 3),
])
def test_shapes(spark, system, text, n, width):
    v = script.run(system, f"v = {text};")["v"]
    rows = [r for r in v.df.collect() if r.frame == 1]
    assert len(rows) == (n or 1) and ("i" in v.df.columns) == (n is not None)
    assert all(width is None and not isinstance(r["value"], list) or len(r["value"]) == width for r in rows)
    if n:
        assert sorted(r.i for r in rows) == list(range(1, n + 1))


def test_coordinates(spark, system):
    names = script.run(system, "x = coord(1:8)[1:2:7, 1]; d = distance(1, 10); {a, b} = {d, d * 2}; {lin, plan, iso} = shape_weights(residue(:)); n = count(residue(resname('PFT') and atom(9:10))); c = count(all, 'chain'); "
                       "r = rmsd(all); s = count(all, 'structure'); lo = distance_min(1:3, 9:12); hi = distance_max(1:3, 9:12); t = distance(vec3(1, 4, 3), 1)")
    at = lambda k: [r["value"] for r in names[k].df.filter("frame = 0").orderBy("frame", *[c for c in ("i",) if c in names[k].df.columns]).collect()]
    assert at("x") == [1.0, 3.0, 5.0, 7.0] and at("d")[0] == pytest.approx(math.dist((1, 4, 3), (2, 1, 2))) and at("b")[0] == 2 * at("a")[0]
    assert at("n") == [4.0] and at("c") == [4.0] and at("s") == [12.0] and at("t") == [0.0]
    assert all(r["value"] == pytest.approx(0, abs=1e-4) for r in names["r"].df.collect())
    assert at("lo")[0] == pytest.approx(math.sqrt(2)) and at("hi")[0] == pytest.approx(math.dist((1, 4, 3), (4, 1, 2)))
    assert [a + b + c for a, b, c in zip(at("lin"), at("plan"), at("iso"), strict=True)] == pytest.approx([1.0] * 4)


def test_fields(spark, system):
    names = script.run(system, "f = rdf(element('C'), element('O'), 4.0); two = f * 2 + 1; same = f - f; low = min(f, 1.0); v = sdf(residue(3:4), element('O'), 5.0); w = abs(-v) + v")
    f = {(r.frame, r.bin): r["value"] for r in names["f"].df.collect()}
    assert f and {k: x * 2 + 1 for k, x in f.items()} == {(r.frame, r.bin): r["value"] for r in names["two"].df.collect()} and names["two"].rest == 1.0
    assert all(r["value"] == 0 for r in names["same"].df.collect()) and max(r["value"] for r in names["low"].df.collect()) == 1.0
    total = sum(r["value"] for r in names["v"].df.collect())
    assert total > 0 and sum(r["value"] for r in names["w"].df.collect()) == 2 * total
    mean = script.averaged(names["f"])
    assert sum(r["value"] for r in mean.collect()) == pytest.approx(sum(f.values()) / 2)


def test_import(spark, system):
    table = spark.createDataFrame([(0.00005, 1.5, 2.0), (1.0, 2.5, 3.0), (7.0, 9.0, 9.0)], "Time double, energy double, pressure double")
    names = script.run(system, "e = import('f', 'energy'); s = e + 1; both = import('f')", tables={"f": table})
    assert [r["value"] for r in names["s"].df.orderBy("frame").collect()] == [2.5, 3.5] and names["both"].depth == 1
    with pytest.raises(language.LanguageError, match="energy"):
        script.run(system, "e = import('f', 'enrgy')", tables={"f": table})
    with pytest.raises(language.LanguageError, match="every frame"):
        script.run(system, "e = import('f', 'energy')", tables={"f": table.filter("Time < 1")})


@pytest.mark.parametrize("text", ["{x,y} = coord(1)[1]", "a = 1; a = 2", "a = nothing(3)", "a = 1 +", "1 = a", "a = {1, {2, 3}}", "a = 'x' + 1", "a = coord(1)[1, 2, 3]", "a = {1, 2}[0]", "a = 1.5 // 2"])
def test_refuses(system, text):
    with pytest.raises(language.LanguageError):
        script.run(system, text)


@pytest.mark.parametrize(("expression", "bits"), [
    ("(atom(1) in residue(:)) in residue(:)", "1001000010001000"), ("chain(2)", "0000000011110000"), ("chain(2:3)", "0000000011111111"), ("nucleotide", "0000000011110000"), ("within(1.5) in residue(3)", "0010000000001000"),
    ("(out atom(1:2)) in residue(3)", "1100000000000000"), ("atom(2) in (element('C') in residue(:))", "0000000000000000"), ("{residue(1), residue(3)}", "1110000011110000"), ("split(atom(1:6), 2)", "1111110000000000"), ("residue(2) in residue(2:3)", "0000000000000000"),
])
def test_contexts(system, expression, bits):
    got = {r.atom_idx for r in language.filter_atoms(system, expression).collect()}
    assert "".join("1" if i + 1 in got else "0" for i in range(16)) == bits


def test_nested_groups(system):
    """Groups of nested contexts stay apart."""
    groups = language.select(system, "(atom(1) in residue(:)) in residue(:)")
    assert sorted((r.group_id, r.atom_idx) for r in groups.collect()) == [(1, 1), (2, 4), (3, 9), (4, 13)]


def test_boxes(spark):
    line = spark.createDataFrame([(0, i, float(i), 0.0, 0.0) for i in range(10)], "frame int, atom_idx long, x double, y double, z double")
    assert spatial.in_sphere(line, (5, 0, 0), 1.5, (10, 0, 0)).count() == 3 and spatial.in_sphere(line, (8.5, 0, 0), 3, (10, 0, 0)).count() == 6
    four = spark.createDataFrame([(0, i, x, 5.0, 5.0) for i, x in enumerate((0.10, 9.90, 9.80, 5.00))], "frame int, atom_idx long, x double, y double, z double")
    assert {r.atom_idx for r in spatial.in_box(four, (0.20, 5, 5), (0.35, 0.20, 0.20), (10, 10, 10)).collect()} == {0, 1}
    assert {r.atom_idx for r in spatial.grow_by_radius(four, four.filter("atom_idx = 0"), 0.25, (10, 10, 10)).collect()} == {0, 1}


@pytest.mark.parametrize("matrix", [[[10.0, 0, 0], [3.0, 9.0, 0], [2.0, 1.0, 8.0]], [[7.0, 0, 0], [-3.0, 6.0, 0], [2.0, -2.5, 9.0]]])
def test_triclinic(spark, matrix):
    import random

    rng = random.Random(4)
    pts = [tuple(sum(f * row[k] for f, row in zip(fr, matrix, strict=True)) for k in range(3)) for fr in ([rng.random() * 3 - 1 for _ in range(3)] for _ in range(60))]
    t = spark.createDataFrame([(0, i, *q) for i, q in enumerate(pts)], "frame int, atom_idx long, x double, y double, z double")
    shifts = [tuple(sum(n[i] * matrix[i][k] for i in range(3)) for k in range(3)) for n in ((a, b, c) for a in range(-4, 5) for b in range(-4, 5) for c in range(-4, 5))]
    want = {(i, j) for i in range(60) for j in range(60) if i != j and min(sum((pts[j][k] - pts[i][k] + s[k]) ** 2 for k in range(3)) for s in shifts) <= 2.5 ** 2}
    got = {(r.i, r.j) for r in spatial.triclinic_join(t, t, 2.5, matrix).collect()}
    assert got == want
    wrapped = t.select(*[c.alias(n) for c, n in zip(g.fractional(g.wrap_triclinic(g.vec(), matrix), matrix), "abc", strict=True)]).collect()
    assert all(-1e-9 <= x < 1 + 1e-9 for r in wrapped for x in r)
    assert g.metric(g.cell_from_angles(3, 4, 5, 70, 80, 100))[0][1] == pytest.approx(12 * math.cos(math.radians(100)))


def test_half_cells(spark):
    """A self join over half of the cells around gives each pair once."""
    import random

    rng = random.Random(8)
    pts = [(rng.uniform(-12, 12), rng.uniform(-12, 12), rng.uniform(-12, 12)) for _ in range(150)]
    t = spark.createDataFrame([(0, i, *q) for i, q in enumerate(pts)], "frame int, atom_idx long, x double, y double, z double")
    for cell in ((20.0, 20.0, 20.0), (0, 0, 0), (5.0, 20.0, 0), (8.0, 9.0, 20.0)):
        d2 = lambda p, q: sum((b - a - (n * round((b - a) / n) if n else 0)) ** 2 for a, b, n in zip(p, q, cell, strict=True))  # noqa: E731, B023
        want = sorted((i, j) for i in range(150) for j in range(i + 1, 150) if d2(pts[i], pts[j]) <= 9)
        assert sorted((r.i, r.j) for r in spatial.range_join(t, t, 3.0, cell, ordered=True).collect()) == want
        assert spatial.range_join(t, t, 3.0, cell).count() == 2 * len(want)


def test_superposition(spark):
    turn = [[0.36, 0.48, -0.8], [-0.8, 0.6, 0.0], [0.48, 0.64, 0.6]]
    pts = [(1.0, 2.0, 3.0), (2.0, 2.5, 1.0), (-1.0, 0.0, 2.0), (4.0, 1.0, 0.0), (0.5, -2.0, 1.5)]
    moved = [tuple(sum(turn[i][k] * q[k] for k in range(3)) + 7 for i in range(3)) for q in pts]
    rows = [(f, k, *q, 1.0 + k) for f, ps in enumerate((pts, moved)) for k, q in enumerate(ps)]
    t = spark.createDataFrame(rows, "frame int, k long, x double, y double, z double, mass double")
    assert [r["value"] for r in superposition.rmsd(t).orderBy("frame").collect()] == pytest.approx([0, 0], abs=1e-6)
    flat = spark.createDataFrame([(0, i, x, y, 2.0 + 0.5 * x) for i, (x, y) in enumerate([(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (3.0, 2.0)])], "frame int, k long, x double, y double, z double")
    r = superposition.plane(flat).first()
    assert abs(r.nx / r.nz + 0.5) < 1e-6 and abs(r.ny) < 1e-6 and r.d / r.nz == pytest.approx(2.0)
    box = superposition.oriented_bounds(t.filter("frame < 2"))
    a, b = box.orderBy("frame").collect()
    assert [a.size_1, a.size_2, a.size_3] == pytest.approx([b.size_1, b.size_2, b.size_3])


def test_bonds(spark, system):
    atoms = spark.createDataFrame([(1, "X", "Fe", 26, 55.8, 1.3, 0, 2), (2, "N", "N", 7, 14.0, 0.71, 0, 2), (3, "A", "C", 6, 12.0, 2.5, 0, 3), (4, "B", "C", 6, 12.0, 2.5, 0, 4)],
                                  "atom_idx long, type string, element string, z int, mass double, radius double, flags int, comp_idx int")
    at = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0), (0, 2, 2.5, 0.0, 0.0), (0, 3, 50.0, 0.0, 0.0), (0, 4, 54.5, 0.0, 0.0)], "frame int, atom_idx long, x double, y double, z double")
    s = System(atoms, system.components, system.instances, system.bonds, at)
    assert sorted((r.i, r.j) for r in properties.covalent_bonds(s).collect()) == [(1, 2), (3, 4)]


def test_contacts_by_bonds(system):
    """Atoms up to four bonds from those that both sides share do not count."""
    a = system.trajectory.join(language.select(system, "atom(1:3)"), "atom_idx")
    b = system.trajectory.join(language.filter_atoms(system, "atom(3:12)"), "atom_idx")
    near = {(r.frame, r.n) for r in properties.contacts(system, a, b, 2.5).collect()}
    pts = {r.atom_idx: (r.x, r.y, r.z) for r in system.trajectory.filter("frame = 0").collect()}
    want = sum(math.dist(pts[i], pts[j]) <= 2.5 for i in (1, 2, 3) for j in range(4, 13))
    assert near == {(0, want), (1, want)}


def test_strings(spark):
    df = spark.createDataFrame([("Path/to.d/File.tar.GZ", "  1.5e2 kJ x", "patch", "Cα1")], "p string, t string, q string, r string")
    s, c = strings, F.col
    got = df.select(s.extension(c("p")), s.folder(c("p")), s.find(c("p"), "t"), s.find_last(c("p"), "t"), s.trim(c("t")), s.parse_float(c("t")), s.parse_int(c("t")), s.common_prefix(c("q"), F.lit("path")), s.tokens(c("t")), s.tokens(c("p"), "."),
                    s.equal(c("q"), F.lit("PATCH"), ignore_case=True), s.equal(c("q"), F.lit("paxxx"), 2), s.substring(c("q"), 1, 3), s.edit_distance(c("q"), F.lit("pitch")), s.matches_pattern(c("r"), "C?#"), s.matches_pattern(c("q"), "p*h"),
                    s.from_base64(s.to_base64(c("q"))).cast("string"), s.hash64(c("q")).isNotNull(), s.hash32(c("q")).isNotNull(), s.parse_float(c("q"))).first()
    assert list(got) == ["GZ", "Path/to.d/", 2, 15, "1.5e2 kJ x", 150.0, 1, 3, ["1.5e2", "kJ", "x"], ["Path/to", "d/File", "tar", "GZ"], True, True, "atc", 1, True, True, "patch", True, True, None]


def test_units():
    u = units.parse
    assert u("kJ/mol").factor(u("J/mol")) == pytest.approx(1000) and u("m/s^2").exponents[2] == -2 and u("nm").factor(u("Å")) == pytest.approx(10) and str(u("kg*m/s^2")) == "N"
    assert (u("m") + u("s")) is None and (u("m") - u("m")) == u("m") and (u("m") ** 2 / u("m")).same(u("m")) and u("ps").inverse().same(u("THz"))
    assert units.from_label("Energy (kJ/mol)").same(u("kJ/mol")) and units.from_label("Energy") is None
    with pytest.raises(ValueError):
        u("m").factor(u("s"))
    with pytest.raises(ValueError):
        u("parsec")


def test_selection_bits(spark, system):
    from orrery.operators import selection as sel

    chosen = language.filter_atoms(system, "atom(2, 3, 5, 9)")
    assert sel.popcount(chosen).first()["n"] == 4 and sel.popcount(chosen, 3, 8).first()["n"] == 2
    assert sel.test_range(chosen, 2, 3).first().asDict() == {"any": True, "all": True} and sel.test_range(chosen, 3, 5).first().asDict() == {"any": True, "all": False}
    assert sel.test_range(chosen, 6, 8).first().asDict() == {"any": False, "all": False}
    assert [r.atom_idx for r in sel.indices(chosen).collect()] == [2, 3, 5, 9]
    again = language.filter_atoms(system, "atom(9) or atom(5) or atom(2:3)")
    assert sel.content_hash(chosen).first() == sel.content_hash(again).first() != sel.content_hash(chosen.filter("atom_idx > 2")).first()
    assert sorted(r.atom_idx for r in sel.deserialize(sel.serialize(chosen)).collect()) == [2, 3, 5, 9]
    assert language.to_json("a = atom(1:2) in residue(:) + {1, 2.5}[1]; b = not all") == language.to_json("a = atom(1:2) in (residue(:) + {1, 2.5}[1]);b=not all")
