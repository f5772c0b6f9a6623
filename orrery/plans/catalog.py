"""Every registered query of the engine, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import arrays as arr
from orrery.functions import geometry as g
from orrery.operators import pairs
from orrery.operators import properties as p
from orrery.operators import selection as sel
from orrery.operators import spatial, structure, volumes
from orrery.functions import names
from orrery.functions import strings as st
from orrery.functions import units
from orrery.plans import language, script
from orrery.schema import System
from orrery.sources.surrogate import CELL, PEPTIDE_SQL, peptide, sql, system

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_R = 4
_L = CELL[0]


def _on_system(name: str, statement: str, recursive: bool = False) -> Callable:
    def add(build: Callable[[System], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: build(system(spark, sf_dir))
        ORACLE_SQL[name] = sql(statement, recursive)
        return build

    return add


def _keys(df: DataFrame) -> DataFrame:
    return df.select(F.col("atom_idx").cast("long"))


def _groups(df: DataFrame) -> DataFrame:
    return df.select(F.col("group_id").cast("long"), F.col("atom_idx").cast("long"))


# --- selectors -------------------------------------------------------------------------------------------------------
_ATOM = "SELECT atom_idx FROM atoms"
for _name, _build, _where in (
    ("sel_all", lambda s: sel.atoms(s), "true"),
    ("sel_name", lambda s: sel.atoms(s, sel.matches("type", ("CA", "N"))), "type IN ('CA', 'N')"),
    ("sel_name_wildcard", lambda s: sel.atoms(s, sel.matches("type", ("H*", "*A"))), "type LIKE 'H%' OR type LIKE '%A'"),
    ("sel_element_str", lambda s: sel.atoms(s, F.col("element").isin("C", "He")), "element IN ('C', 'He')"),
    ("sel_element_range_stride", lambda s: sel.atoms(s, sel.in_range("z", 1, 8, 2)), "z BETWEEN 1 AND 8 AND (z - 1) % 2 = 0"),
    ("sel_atom_range", lambda s: sel.atoms(s, sel.in_range("atom_idx", 5, 120)), "atom_idx BETWEEN 5 AND 120"),
    ("sel_atom_stride", lambda s: sel.atoms(s, sel.in_range("atom_idx", 2, None, 3)), "atom_idx >= 2 AND (atom_idx - 2) % 3 = 0"),
    ("sel_atom_list", lambda s: sel.atoms(s, F.col("atom_idx").isin(1, 7, 9)), "atom_idx IN (1, 7, 9)"),
    ("sel_backbone", lambda s: sel.flagged(s, 0x4), "flags & 4 <> 0"),
    ("sel_sidechain", lambda s: sel.flagged(s, 0x400), "flags & 1024 <> 0"),
    ("sel_side", lambda s: sel.flagged(s, 0x400 | 0x2000), "flags & 9216 <> 0"),
    ("sel_nucleoside", lambda s: sel.flagged(s, 0x2000), "flags & 8192 <> 0"),
    ("sel_nucleobase", lambda s: sel.flagged(s, 0x4000), "flags & 16384 <> 0"),
    ("sel_and", lambda s: sel.intersect(sel.flagged(s, 0x4), sel.atoms(s, sel.in_range("atom_idx", 10, 300))), "flags & 4 <> 0 AND atom_idx BETWEEN 10 AND 300"),
    ("sel_or", lambda s: sel.union(sel.flagged(s, 0x400), sel.atoms(s, sel.in_range("atom_idx", 1, 50))), "flags & 1024 <> 0 OR atom_idx BETWEEN 1 AND 50"),
    ("sel_xor", lambda s: sel.symmetric(sel.flagged(s, 0x400), sel.atoms(s, sel.in_range("atom_idx", 1, 50))), "(flags & 1024 <> 0) <> (atom_idx BETWEEN 1 AND 50)"),
    ("sel_not", lambda s: sel.complement(s, sel.flagged(s, 0x4)), "NOT flags & 4 <> 0"),
    ("sel_andnot", lambda s: sel.subtract(sel.flagged(s, 0x4), sel.atoms(s, F.col("z") == 7)), "flags & 4 <> 0 AND z <> 7"),
    ("sel_ion", lambda s: sel.flatten(sel.components(s, F.col("flags").bitwiseAND(0x40000) != 0)), "comp_idx IN (SELECT comp_idx FROM components WHERE flags & 262144 <> 0)"),
    ("sel_join_flatten", lambda s: sel.flatten(sel.components(s, F.col("name") == "LYS")), "comp_idx IN (SELECT comp_idx FROM components WHERE name = 'LYS')"),
):
    _on_system(_name, f"{_ATOM} WHERE {_where}")(lambda s, b=_build: _keys(b(s)))

_COMP = "SELECT a.comp_idx AS group_id, atom_idx FROM atoms a JOIN components c ON a.comp_idx = c.comp_idx WHERE "
for _name, _pred, _where in (
    ("sel_protein", lambda: F.col("flags").bitwiseAND(0x200) != 0, "c.flags & 512 <> 0"), ("sel_nucleic", lambda: F.col("flags").bitwiseAND(0x800) != 0, "c.flags & 2048 <> 0"),
    ("sel_water", lambda: F.col("flags").bitwiseAND(0x20000) != 0, "c.flags & 131072 <> 0"), ("sel_resname", lambda: sel.matches("name", ("SOL", "L*")), "name = 'SOL' OR name LIKE 'L%'"),
    ("sel_resid_range", lambda: sel.in_range("seq_id", 11, 17, 2), "seq_id BETWEEN 11 AND 17 AND (seq_id - 11) % 2 = 0"), ("sel_component_range", lambda: sel.in_range("comp_idx", 2, 5), "c.comp_idx BETWEEN 2 AND 5"),
):
    _on_system(_name, _COMP + _where)(lambda s, q=_pred: _groups(sel.components(s, q())))

_INST = "SELECT c.inst_idx AS group_id, atom_idx FROM atoms a JOIN components c ON a.comp_idx = c.comp_idx JOIN instances i ON c.inst_idx = i.inst_idx WHERE "
for _name, _pred, _poly, _where in (
    ("sel_instance_id", lambda: F.col("id").isin("A", "B"), False, "i.id IN ('A', 'B')"), ("sel_instance_range", lambda: sel.in_range("inst_idx", 2, 3), False, "i.inst_idx BETWEEN 2 AND 3"),
    ("sel_auth_id", lambda: F.col("auth_id") == "Y", False, "i.auth_id = 'Y'"), ("sel_chain_polymer", lambda: F.col("id").isin("A", "B"), True, "i.id IN ('A', 'B') AND i.flags & 2 <> 0"),
):
    _on_system(_name, _INST + _where)(lambda s, q=_pred, y=_poly: _groups(sel.instances(s, q(), y)))


@_on_system("sel_split", """r AS (SELECT min(atom_idx) AS lo, max(atom_idx) - min(atom_idx) + 1 AS n FROM atoms WHERE atom_idx BETWEEN 4 AND 103)
SELECT CASE WHEN atom_idx - lo < n * 1 // 3 THEN 1 WHEN atom_idx - lo < n * 2 // 3 THEN 2 ELSE 3 END::BIGINT AS group_id, atom_idx FROM atoms, r WHERE atom_idx BETWEEN 4 AND 103""")
def _split(s: System) -> DataFrame:
    return _groups(sel.split(sel.atoms(s, sel.in_range("atom_idx", 4, 103)), 3))


@_on_system("fill_component", "SELECT comp_idx AS group_id, atom_idx FROM atoms WHERE comp_idx IN (SELECT comp_idx FROM atoms WHERE atom_idx BETWEEN 1 AND 4)")
def _fill(s: System) -> DataFrame:
    return _groups(sel.whole_components(s, sel.atoms(s, sel.in_range("atom_idx", 1, 4))))


@_on_system("fill_instance", """o AS (SELECT atom_idx, inst_idx FROM atoms a JOIN components c ON a.comp_idx = c.comp_idx)
SELECT inst_idx AS group_id, atom_idx FROM o WHERE inst_idx IN (SELECT inst_idx FROM o WHERE atom_idx BETWEEN 1 AND 2)""")
def _fill_instance(s: System) -> DataFrame:
    return _groups(sel.whole_instances(s, sel.atoms(s, sel.in_range("atom_idx", 1, 2))))


@_on_system("khop_grow", """n AS (SELECT i, j FROM bonds UNION SELECT j, i FROM bonds),
h AS (SELECT 17 AS a, 0 AS d UNION SELECT n.j, d + 1 FROM h JOIN n ON n.i = h.a WHERE d < 3) SELECT DISTINCT a::BIGINT AS atom_idx FROM h""", recursive=True)
def _khop(s: System) -> DataFrame:
    return _keys(sel.grow_by_bonds(s, sel.atoms(s, F.col("atom_idx") == 17), 3))


# --- the selection language ------------------------------------------------------------------------------------------
_NAMED = "a.comp_idx IN (SELECT comp_idx FROM components WHERE name = '{}')"
for _name, _text, _where in (
    ("filter_boolean", "element('C') and not resname('SOL') or atom(1:10)", f"a.element = 'C' AND NOT {_NAMED.format('SOL')} OR a.atom_idx BETWEEN 1 AND 10"),
    ("filter_strided", "atom(2:3:200) and type('C*', '*1')", "a.atom_idx BETWEEN 2 AND 200 AND (a.atom_idx - 2) % 3 = 0 AND (type LIKE 'C%' OR type LIKE '%1')"),
    ("filter_expand", "residue(atom(1:2))", "a.comp_idx IN (SELECT comp_idx FROM atoms WHERE atom_idx BETWEEN 1 AND 2)"),
    ("filter_box", "within_xyz(-4:4, -3:3, 0:5) xor backbone", "(a.atom_idx IN (SELECT atom_idx FROM traj WHERE frame = 0 AND x BETWEEN -4 AND 4 AND y BETWEEN -3 AND 3 AND z BETWEEN 0 AND 5)) <> (flags & 4 <> 0)"),
):
    _on_system(_name, f"SELECT a.atom_idx FROM atoms a WHERE {_where}")(lambda s, q=_text: _keys(language.filter_atoms(s, q)))


@_on_system("filter_in_context", "r AS (SELECT atom_idx, comp_idx, atom_idx - min(atom_idx) OVER (PARTITION BY comp_idx) + 1 AS k FROM atoms) SELECT comp_idx AS group_id, atom_idx FROM r WHERE k <= 2")
def _in_context(s: System) -> DataFrame:
    return _groups(language.select(s, "atom(1:2) in residue(:)"))


# --- spatial ---------------------------------------------------------------------------------------------------------
def _mi(d: str) -> str:
    return f"(({d}) - {_L} * round(({d}) / {_L}))"


def _d2(a: str, b: str) -> str:
    return " + ".join(f"{_mi(f'{b}.{c} - {a}.{c}')} * {_mi(f'{b}.{c} - {a}.{c}')}" for c in "xyz")


for _name, _pred, _where in (("within_x", lambda: F.col("x").between(-2, 3), "x BETWEEN -2 AND 3"), ("within_y", lambda: F.col("y").between(0, 3), "y BETWEEN 0 AND 3"), ("within_z", lambda: F.col("z").between(-1, 1), "z BETWEEN -1 AND 1"),
                             ("within_xyz", lambda: F.col("x").between(-4, 4) & F.col("y").between(-3, 3) & F.col("z").between(0, 5), "x BETWEEN -4 AND 4 AND y BETWEEN -3 AND 3 AND z BETWEEN 0 AND 5")):
    _on_system(_name, f"SELECT frame::INTEGER AS frame, atom_idx FROM traj WHERE {_where}")(lambda s, q=_pred: s.trajectory.filter(q()).select(F.col("frame").cast("int"), "atom_idx"))

_NEAR = f"""SELECT DISTINCT b.frame::INTEGER AS frame, b.atom_idx FROM traj a JOIN traj b ON a.frame = b.frame AND a.atom_idx BETWEEN 1 AND 20 AND b.atom_idx > 20
WHERE {_d2('a', 'b')} BETWEEN %s AND 9.0"""
for _name, _least in (("within_radius", 0.0), ("within_shell", 2.0)):
    @_on_system(_name, _NEAR % (_least * _least))
    def _within(s: System, least: float = _least) -> DataFrame:
        return spatial.within(s.trajectory, s.trajectory.filter("atom_idx BETWEEN 1 AND 20"), 3.0, s.cell, least).select(F.col("frame").cast("int"), "atom_idx")


@_on_system("range_join_pairs", f"SELECT a.frame::INTEGER AS frame, count(*) AS n FROM traj a JOIN traj b ON a.frame = b.frame AND a.atom_idx < b.atom_idx WHERE {_d2('a', 'b')} <= 4.0 GROUP BY a.frame")
def _pairs(s: System) -> DataFrame:
    return pairs.count_pairs(s.trajectory, 2.0, s.cell).select(F.col("frame").cast("int"), "n")


@_on_system("covalent_bonds", f"""t AS (SELECT traj.*, radius, comp_idx FROM traj JOIN (SELECT atom_idx, radius, comp_idx FROM atoms) USING (atom_idx) WHERE frame = 0),
q AS (SELECT a.atom_idx AS i, b.atom_idx AS j, sqrt({_d2('a', 'b')}) AS d, a.radius + b.radius AS r, a.comp_idx = b.comp_idx AS same FROM t a JOIN t b ON a.atom_idx < b.atom_idx)
SELECT i, j FROM q WHERE d > r * 0.65 AND d < r * 1.15 * CASE WHEN same THEN 1.05 ELSE 1 END""")
def _bonds(s: System) -> DataFrame:
    return p.covalent_bonds(s)


@_on_system("contact_count", f"""SELECT a.frame::INTEGER AS frame, c.comp_idx AS group_id, count(*) AS n FROM traj a JOIN atoms c ON a.atom_idx = c.atom_idx JOIN traj b ON a.frame = b.frame AND a.atom_idx <> b.atom_idx
WHERE c.comp_idx IN (1, 2) AND b.atom_idx IN (SELECT atom_idx FROM atoms WHERE comp_idx = 3) AND {_d2('a', 'b')} <= 6.25 GROUP BY ALL""")
def _contacts(s: System) -> DataFrame:
    a = s.trajectory.join(sel.components(s, F.col("comp_idx").isin(1, 2)), "atom_idx")
    b = s.trajectory.join(sel.components(s, F.col("comp_idx") == 3).select("atom_idx"), "atom_idx")
    return p.contacts(s, a, b, 2.5).select(F.col("frame").cast("int"), F.col("group_id").cast("long"), "n")


# --- properties ------------------------------------------------------------------------------------------------------
def _points(s: System, name: str) -> DataFrame:
    return p.positions(s, sel.flatten(sel.components(s, F.col("name") == name)))


def _com_sql(alias: str, name: str) -> str:
    return f"""{alias} AS (SELECT frame, sum(x * mass) / sum(mass) AS x, sum(y * mass) / sum(mass) AS y, sum(z * mass) / sum(mass) AS z
  FROM traj JOIN (SELECT atom_idx, mass, comp_idx FROM atoms) a USING (atom_idx) JOIN (SELECT comp_idx, name FROM components) c USING (comp_idx) WHERE c.name = '{name}' GROUP BY frame)"""


def _value(df: DataFrame) -> DataFrame:
    return df.select(F.col("frame").cast("int"), F.round("value", _R).alias("value"))


@_on_system("distance_com", f"{_com_sql('a', 'SOL')}, {_com_sql('b', 'LYS')} SELECT a.frame::INTEGER AS frame, round(sqrt({_d2('a', 'b')}), {_R}) AS value FROM a JOIN b USING (frame)")
def _distance(s: System) -> DataFrame:
    return _value(p.distance(_points(s, "SOL"), _points(s, "LYS"), s.cell))


@_on_system("com_plain", f"{_com_sql('a', 'PFT')} SELECT frame::INTEGER AS frame, round(x, {_R}) AS x, round(y, {_R}) AS y, round(z, {_R}) AS z FROM a")
def _com(s: System) -> DataFrame:
    return p.com(_points(s, "PFT")).select(F.col("frame").cast("int"), *[F.round(c, _R).alias(c) for c in "xyz"])


def _circ(c: str) -> str:
    k = 2 * 3.141592653589793 / _L
    m = f"atan2(sum(sin({c} * {k}) * mass), sum(cos({c} * {k}) * mass)) / {k}"
    return f"round({m} - {_L} * floor({m} / {_L}), {_R}) AS {c}"


@_on_system("com_pbc", f"SELECT frame::INTEGER AS frame, {', '.join(map(_circ, 'xyz'))} FROM traj JOIN (SELECT atom_idx, mass, comp_idx FROM atoms) a USING (atom_idx) WHERE comp_idx = 2 GROUP BY frame")
def _com_pbc(s: System) -> DataFrame:
    return p.com_periodic(p.positions(s, sel.flatten(sel.components(s, F.col("comp_idx") == 2))), s.cell).select(F.col("frame").cast("int"), *[F.round(c, _R).alias(c) for c in "xyz"])


_PAIRS = f"pr AS (SELECT a.frame, a.atom_idx AS i, b.atom_idx AS j, sqrt({_d2('a', 'b')}) AS d FROM traj a JOIN traj b ON a.frame = b.frame WHERE a.atom_idx <= 10 AND b.atom_idx BETWEEN 11 AND 40) "


def _pair_table(s: System) -> DataFrame:
    return p.distance_pairs(s.trajectory.filter("atom_idx <= 10"), s.trajectory.filter("atom_idx BETWEEN 11 AND 40"), s.cell)


@_on_system("distance_pair", _PAIRS + f"SELECT frame::INTEGER AS frame, i, j, round(d, {_R}) AS d FROM pr")
def _pair(s: System) -> DataFrame:
    return _pair_table(s).select(F.col("frame").cast("int"), "i", "j", F.round("d", _R).alias("d"))


for _name, _f in (("distance_min", F.min), ("distance_max", F.max)):
    @_on_system(_name, _PAIRS + f"SELECT frame::INTEGER AS frame, round({_name[-3:]}(d), {_R}) AS value FROM pr GROUP BY frame")
    def _extreme(s: System, f: Callable = _f) -> DataFrame:
        return _value(_pair_table(s).groupBy("frame").agg(f("d").alias("value")))


# the same over all atoms of two elements
_WHOLE_PAIRS = f"""pr AS (SELECT a.frame, a.atom_idx AS i, b.atom_idx AS j, sqrt({_d2('a', 'b')}) AS d FROM traj a JOIN traj b ON a.frame = b.frame
  WHERE a.atom_idx IN (SELECT atom_idx FROM atoms WHERE element = 'C') AND b.atom_idx IN (SELECT atom_idx FROM atoms WHERE element = 'O')) """


def _of_elements(s: System) -> list[DataFrame]:
    return [s.trajectory.join(sel.atoms(s, F.col("element") == e), "atom_idx") for e in "CO"]


@_on_system("distance_pair_whole", _WHOLE_PAIRS + f"SELECT frame::INTEGER AS frame, i, j, round(d, {_R}) AS d FROM pr")
def _whole_pair(s: System) -> DataFrame:
    return p.distance_pairs(*_of_elements(s), s.cell, 16).select(F.col("frame").cast("int"), "i", "j", F.round("d", _R).alias("d"))


for _name, _largest in (("distance_min_whole", False), ("distance_max_whole", True)):
    @_on_system(_name, _WHOLE_PAIRS + f"SELECT frame::INTEGER AS frame, round({_name[9:12]}(d), {_R}) AS value FROM pr GROUP BY frame")
    def _whole_extreme(s: System, largest: bool = _largest) -> DataFrame:
        return _value(pairs.extreme(*_of_elements(s), s.cell, largest))


def _frame_points(s: System) -> list[DataFrame]:
    return [_points(s, n) for n in ("SOL", "LYS", "PFT", "ALA")]


@_on_system("angle", f"""{_com_sql('a', 'SOL')}, {_com_sql('b', 'LYS')}, {_com_sql('c', 'PFT')}
SELECT frame::INTEGER AS frame, round(acos(((a.x-b.x)*(c.x-b.x)+(a.y-b.y)*(c.y-b.y)+(a.z-b.z)*(c.z-b.z)) / (sqrt((a.x-b.x)^2+(a.y-b.y)^2+(a.z-b.z)^2) * sqrt((c.x-b.x)^2+(c.y-b.y)^2+(c.z-b.z)^2))), {_R}) AS value
FROM a JOIN b USING (frame) JOIN c USING (frame)""")
def _angle(s: System) -> DataFrame:
    return _value(p.angle(*_frame_points(s)[:3]))


@_on_system("dihedral", f"""{_com_sql('a', 'SOL')}, {_com_sql('b', 'LYS')}, {_com_sql('c', 'PFT')}, {_com_sql('d', 'ALA')},
e AS (SELECT a.frame, {', '.join(f"{_mi(f'{q}.{c} - {o}.{c}')} AS {n}{c}" for n, o, q in (('u', 'a', 'b'), ('v', 'b', 'c'), ('w', 'c', 'd')) for c in 'xyz')}
  FROM a JOIN b USING (frame) JOIN c USING (frame) JOIN d USING (frame)),
n AS (SELECT *, uy*vz-uz*vy AS px, uz*vx-ux*vz AS py, ux*vy-uy*vx AS pz, vy*wz-vz*wy AS qx, vz*wx-vx*wz AS qy, vx*wy-vy*wx AS qz FROM e)
SELECT frame::INTEGER AS frame, round(atan2(sqrt(vx*vx+vy*vy+vz*vz) * (ux*qx+uy*qy+uz*qz), px*qx+py*qy+pz*qz), {_R}) AS value FROM n""")
def _dihedral(s: System) -> DataFrame:
    return _value(p.dihedral(_frame_points(s), s.cell))


for _name, _low in (("rdf", 0.0), ("rdf_range", 2.0)):
    @_on_system(_name, f"""q AS (SELECT a.frame, round(sqrt({_d2('a', 'b')}), 9) AS d FROM traj a JOIN traj b ON a.frame = b.frame AND a.atom_idx <> b.atom_idx
  JOIN atoms p ON p.atom_idx = a.atom_idx AND p.element = 'C' JOIN atoms o ON o.atom_idx = b.atom_idx AND o.element = 'O')
SELECT frame::INTEGER AS frame, least(floor((d - {max(_low, 1e-3)}) / {(5.0 - _low) / 64}), 63)::BIGINT AS bin, count(*) AS n FROM q WHERE d >= {max(_low, 1e-3)} AND d <= 5.0 GROUP BY ALL""")
    def _rdf(s: System, low: float = _low) -> DataFrame:
        c, o = (s.trajectory.join(sel.atoms(s, F.col("element") == e), "atom_idx") for e in "CO")
        return p.rdf(c, o, s.cell, 5.0, low, 64).select(F.col("frame").cast("int"), F.col("bin").cast("long"), "n")


for _axis in "xyz":
    @_on_system(f"density_{_axis}", f"""q AS (SELECT frame, round({_axis} - {_L} * floor({_axis} / {_L}), 9) AS u, mass FROM (SELECT frame, atom_idx, {_axis} FROM traj) JOIN (SELECT atom_idx, mass FROM atoms) USING (atom_idx))
SELECT frame::INTEGER AS frame, least(floor(u / {_L / 64}), 63)::BIGINT AS bin, round(sum(mass) * {p.DENSITY} / {_L ** 3 / 64}, {_R}) AS value FROM q GROUP BY ALL""")
    def _density(s: System, axis: str = _axis) -> DataFrame:
        return p.density(p.positions(s, sel.atoms(s)), axis, s.cell, 64).select(F.col("frame").cast("int"), F.col("bin").cast("long"), F.round("value", _R).alias("value"))


_OF = "FROM (SELECT frame, atom_idx, x, y, z FROM traj) JOIN (SELECT atom_idx, mass, comp_idx FROM atoms) USING (atom_idx)"
_COV = "cov AS (SELECT frame, comp_idx, " + ", ".join(f"sum({a}*{b}*mass)/sum(mass) - sum({a}*mass)/sum(mass)*(sum({b}*mass)/sum(mass)) AS {a}{b}" for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")) + f" {_OF} GROUP BY ALL)"


@_on_system("shape_weights", _COV + f""",
q AS (SELECT *, (xx+yy+zz)/3 AS q FROM cov), s AS (SELECT *, sqrt(((xx-q)*(xx-q)+(yy-q)*(yy-q)+(zz-q)*(zz-q)+2*(xy*xy+xz*xz+yz*yz))/6) AS p FROM q),
r AS (SELECT *, acos(greatest(-1, least(1, ((xx-q)*((yy-q)*(zz-q)-yz*yz) - xy*(xy*(zz-q)-yz*xz) + xz*(xy*yz-(yy-q)*xz)) / (2*p*p*p))))/3 AS phi FROM s),
l AS (SELECT frame, comp_idx, q, q+2*p*cos(phi) AS a, q+2*p*cos(phi+2.0943951023931953) AS c FROM r), e AS (SELECT frame, comp_idx, a, 3*q-a-c AS b, c FROM l)
SELECT frame::INTEGER AS frame, comp_idx, round((a-b)/(a+b+c), {_R}) AS linear, round(2*(b-c)/(a+b+c), {_R}) AS planar, round(3*c/(a+b+c), {_R}) AS isotropic FROM e""")
def _shape(s: System) -> DataFrame:
    return p.shape_weights(p.positions(s, sel.atoms(s)), ("frame", "comp_idx")).select(F.col("frame").cast("int"), "comp_idx", *[F.round(c, _R).alias(c) for c in ("linear", "planar", "isotropic")])


@_on_system("aabb", "SELECT frame::INTEGER AS frame, comp_idx, " + ", ".join(f"round({f}({c} {'+' if f == 'max' else '-'} radius), {_R}) AS {f}_{c}" for f in ("min", "max") for c in "xyz") + f" {_OF.replace('comp_idx FROM', 'comp_idx, radius FROM')} GROUP BY ALL")
def _aabb(s: System) -> DataFrame:
    b = p.bounds(p.positions(s, sel.atoms(s)).join(s.atoms.select("atom_idx", "radius"), "atom_idx"), ("frame", "comp_idx"), "radius")
    return b.select(F.col("frame").cast("int"), "comp_idx", *[F.round(c, _R).alias(c) for c in b.columns[2:]])


for _name, _col in (("count_atom", "atom_idx"), ("count_residue", "comp_idx"), ("count_chain", "inst_idx")):
    @_on_system(_name, f"SELECT frame::INTEGER AS frame, count(DISTINCT {_col}) AS n FROM traj t JOIN (SELECT atom_idx, comp_idx FROM atoms) USING (atom_idx) JOIN (SELECT comp_idx, inst_idx FROM components) USING (comp_idx) WHERE x > 5 GROUP BY frame")
    def _count(s: System, col: str = _col) -> DataFrame:
        t = s.trajectory.filter("x > 5").join(s.atoms.select("atom_idx", "comp_idx"), "atom_idx").join(s.components.select("comp_idx", "inst_idx"), "comp_idx")
        return t.groupBy(F.col("frame").cast("int").alias("frame")).agg(F.count_distinct(col).alias("n"))


@_on_system("coord_xyz", f"SELECT frame::INTEGER AS frame, atom_idx, round(x, {_R}) AS x, round(y, {_R}) AS y, round(z, {_R}) AS z FROM traj WHERE atom_idx <= 25")
def _coord(s: System) -> DataFrame:
    return s.trajectory.filter("atom_idx <= 25").select(F.col("frame").cast("int"), "atom_idx", *[F.round(c, _R).alias(c) for c in "xyz"])


@_on_system("coord_xyz_whole", f"SELECT frame::INTEGER AS frame, atom_idx, round(x, {_R}) AS x, round(y, {_R}) AS y, round(z, {_R}) AS z FROM traj")
def _whole_coord(s: System) -> DataFrame:
    return s.trajectory.select(F.col("frame").cast("int"), "atom_idx", *[F.round(c, _R).alias(c) for c in "xyz"])


@_on_system("pbc_wrap", "SELECT frame::INTEGER AS frame, atom_idx, " + ", ".join(f"round({c} - {_L} * floor({c} / {_L}), {_R}) AS {c}" for c in "xyz") + " FROM traj")
def _wrap(s: System) -> DataFrame:
    return s.trajectory.select(F.col("frame").cast("int"), "atom_idx", *[F.round(g.wrap(F.col(c), n), _R).alias(c) for c, n in zip("xyz", s.cell, strict=True)])


@_on_system("interp_linear", "n AS (SELECT *, " + ", ".join(f"lead({c}) OVER w AS n{c}" for c in "xyz") + " FROM traj WINDOW w AS (PARTITION BY atom_idx ORDER BY frame)) SELECT frame::INTEGER AS frame, atom_idx, "
            + ", ".join(f"round({c} + {_mi(f'n{c} - {c}')} * 0.25, {_R}) AS {c}" for c in "xyz") + " FROM n WHERE nx IS NOT NULL")
def _interp(s: System) -> DataFrame:
    return p.interpolate(s, 0.25).select(F.col("frame").cast("int"), "atom_idx", *[F.round(c, _R).alias(c) for c in "xyz"])


_CUBIC = "n AS (SELECT *, " + ", ".join(f"lag({c}) OVER w AS a{c}, lead({c}) OVER w AS c{c}, lead({c}, 2) OVER w AS d{c}" for c in "xyz") + " FROM traj WINDOW w AS (PARTITION BY atom_idx ORDER BY frame)) SELECT frame::INTEGER AS frame, atom_idx, "


def _cubic_sql(c: str) -> str:
    a, d = _mi(f"a{c} - {c}"), _mi(f"c{c} - {c}")
    e = f"({d} + {_mi(f'd{c} - c{c}')})"
    return f"round({c} + ({d} - {a}) / 2 * 0.25 + ({a} + 2 * {d} - {e} / 2) * 0.0625 + ((-{a} - 3 * {d} + {e}) / 2) * 0.015625, {_R}) AS {c}"


@_on_system("interp_cubic", _CUBIC + ", ".join(map(_cubic_sql, "xyz")) + " FROM n WHERE ax IS NOT NULL AND dx IS NOT NULL")
def _interp_cubic(s: System) -> DataFrame:
    return p.interpolate_cubic(s, 0.25).select(F.col("frame").cast("int"), "atom_idx", *[F.round(c, _R).alias(c) for c in "xyz"])


@_on_system("structures", """d AS (SELECT atom_idx AS a, atom_idx AS b FROM atoms WHERE atom_idx NOT IN (SELECT greatest(i, j) FROM bonds) UNION SELECT d.a, e.j FROM d JOIN (SELECT i, j FROM bonds UNION SELECT j, i FROM bonds) e ON d.b = e.i)
SELECT b AS atom_idx, min(a) AS structure FROM d GROUP BY b""", recursive=True)
def _structures(s: System) -> DataFrame:
    return p.structures(s).select("atom_idx", "structure")


@_on_system("property_temporal_stats", f"SELECT frame::INTEGER AS frame, round(avg(x), {_R}) AS mean, round(var_pop(x), {_R}) AS var, round(min(x), {_R}) AS min, round(max(x), {_R}) AS max FROM traj GROUP BY frame")
def _stats(s: System) -> DataFrame:
    return p.frame_stats(s.trajectory, "x").select(F.col("frame").cast("int"), *[F.round(c, _R).alias(c) for c in ("mean", "var", "min", "max")])


@_on_system("bond_degree", "SELECT i AS atom_idx, count(*) AS n FROM (SELECT i, j FROM bonds UNION ALL SELECT j, i FROM bonds) GROUP BY i")
def _degree(s: System) -> DataFrame:
    return s.bonds.select("i").union(s.bonds.select("j")).groupBy(F.col("i").alias("atom_idx")).agg(F.count("*").alias("n"))


@_on_system("morton_sort", """t AS (SELECT * FROM traj WHERE frame = 0), b AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz, greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z)) AS e FROM t),
k AS (SELECT atom_idx, floor((x-lx)/e*1023+0.5)::BIGINT AS x, floor((y-ly)/e*1023+0.5)::BIGINT AS y, floor((z-lz)/e*1023+0.5)::BIGINT AS z FROM t, b)
SELECT atom_idx, """ + " + ".join(f"((({c} >> {i}) & 1) << {3 * i + k})" for i in range(10) for k, c in enumerate("xyz")) + " AS key FROM k")
def _morton(s: System) -> DataFrame:
    return p.morton(s.trajectory.filter("frame = 0"))


# --- arrays and scalars ----------------------------------------------------------------------------------------------
_V = "e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS a FROM embeddings) "


def _array_query(name: str, select: str, build: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("a")))
    ORACLE_SQL[name] = f"WITH {_V} SELECT vec_id, {select} FROM e"


_sum = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), _R)
_array_query("array_add", f"round(list_sum(list_transform(a, lambda v: v + v)), {_R}) AS value", lambda d: d.select("vec_id", _sum(arr.elementwise("+", F.col("a"), F.col("a"))).alias("value")))
_array_query("array_scalar_mul", f"round(list_sum(list_transform(a, lambda v: v * 2.5)), {_R}) AS value", lambda d: d.select("vec_id", _sum(arr.with_scalar("*", F.col("a"), F.lit(2.5))).alias("value")))
_array_query("array_min_max", f"round(list_min(a), {_R}) AS lo, round(list_max(a), {_R}) AS hi", lambda d: d.select("vec_id", F.round(F.array_min("a"), _R).alias("lo"), F.round(F.array_max("a"), _R).alias("hi")))
_array_query("vec_dot_norm", f"round(list_inner_product(a[1:3], a[4:6]), {_R}) AS dot, round(sqrt(list_inner_product(a, a)), {_R}) AS length", lambda d: d.select("vec_id", F.round(arr.dot(F.slice("a", 1, 3), F.slice("a", 4, 3)), _R).alias("dot"), F.round(arr.length(F.col("a")), _R).alias("length")))
_array_query("vec_cross", f"round(a[2]*a[6]-a[3]*a[5], {_R}) AS x, round(a[3]*a[4]-a[1]*a[6], {_R}) AS y, round(a[1]*a[5]-a[2]*a[4], {_R}) AS z", lambda d: d.withColumn("c", arr.cross(F.slice("a", 1, 3), F.slice("a", 4, 3))).select("vec_id", *[F.round(F.col("c")[i], _R).alias(n) for i, n in enumerate("xyz")]))
_array_query("subscript_stride", f"round(a[1] + a[3] + a[5] + a[7], {_R}) AS value", lambda d: d.select("vec_id", _sum(arr.subscript(F.col("a"), 1, 7, 2)).alias("value")))
_array_query("cmp_lt_gt", "len(list_filter(a, lambda v: v < 0.1))::BIGINT AS lt, len(list_filter(a, lambda v: v > 0.1))::BIGINT AS gt", lambda d: d.select("vec_id", *[F.size(F.filter(arr.with_scalar(o, F.col("a"), F.lit(0.1)), lambda x: x)).cast("long").alias(n) for o, n in (("<", "lt"), (">", "gt"))]))
_array_query("transpose", f"round(a[1]*a[2] + a[3]*a[4] + a[5]*a[6], {_R}) AS value", lambda d: d.withColumn("t", arr.transpose(F.array(F.slice("a", 1, 2), F.slice("a", 3, 2), F.slice("a", 5, 2)), 2)).select("vec_id", F.round(arr.dot(F.col("t")[0], F.col("t")[1]), _R).alias("value")))
_array_query("scalar_math", "round(sqrt(abs(a[1])), 4) AS sqrt, round(exp(a[1]), 4) AS exp, round(ln(abs(a[1]) + 1), 4) AS ln, round(log10(abs(a[1]) + 1), 4) AS log10, round(sin(a[1]), 4) AS sin, round(atan2(a[1], a[2]), 4) AS atan2, floor(a[1] * 10)::BIGINT AS floor, ceil(a[1] * 10)::BIGINT AS ceil",
             lambda d: d.withColumns({"x": F.col("a")[0], "y": F.col("a")[1]}).select("vec_id", F.round(F.sqrt(F.abs("x")), 4).alias("sqrt"), F.round(F.exp("x"), 4).alias("exp"), F.round(F.log(F.abs("x") + 1), 4).alias("ln"), F.round(F.log10(F.abs("x") + 1), 4).alias("log10"),
                                                                      F.round(F.sin("x"), 4).alias("sin"), F.round(F.atan2("x", "y"), 4).alias("atan2"), F.floor(F.col("x") * 10).cast("long").alias("floor"), F.ceil(F.col("x") * 10).cast("long").alias("ceil")))


# --- scripts ---------------------------------------------------------------------------------------------------------
def _scripted(name: str, text: str, statement: str, columns: tuple[str, ...] = ()) -> None:
    """The value ``v`` of a script; ``columns`` names the items of an array."""
    def build(s: System) -> DataFrame:
        t = script.table(script.run(s, text)["v"], s.atoms.sparkSession)
        if "group_id" in t.columns:
            return _groups(t)
        keys = [F.col(k).cast("int" if k == "frame" else "long").alias(k) for k in t.columns if k in ("frame", "i", "bin")]
        parts = [F.element_at("value", k).alias(c) for k, c in enumerate(columns, 1)] or [F.col("value")]
        more = [F.col(c) for c in ("axis",) if c in t.columns]
        return t.select(*keys, *more, *[F.round(x.cast("double"), _R).alias(n) for x, n in zip(parts, columns or ("value",), strict=True)])

    _on_system(name, statement)(build)


_T = "t AS (SELECT frame, atom_idx, x, y, z, element, mass, comp_idx FROM traj JOIN (SELECT atom_idx, element, mass, comp_idx FROM atoms) USING (atom_idx))"
_FR = "frame::INTEGER AS frame"
_scripted("script_coord_arith", "x = coord_x(element('C')); v = x * 2 + 1;", f"{_T} SELECT {_FR}, row_number() OVER (PARTITION BY frame ORDER BY atom_idx) AS i, round(x * 2 + 1, {_R}) AS value FROM t WHERE element = 'C'")
_scripted("script_coord_in", "v = coord(1) in residue(:);", f"{_T}, m AS (SELECT *, min(atom_idx) OVER (PARTITION BY frame, comp_idx) AS first FROM t) SELECT {_FR}, row_number() OVER (PARTITION BY frame ORDER BY comp_idx) AS i, round(x, {_R}) AS x, round(y, {_R}) AS y, round(z, {_R}) AS z FROM m WHERE atom_idx = first", ("x", "y", "z"))
_scripted("script_min_max", "{lo, hi} = {min(coord_z(all)), max(coord_z(all))}; v = {lo, hi, hi - lo};", f"SELECT {_FR}, round(min(z), {_R}) AS lo, round(max(z), {_R}) AS hi, round(max(z) - min(z), {_R}) AS span FROM traj GROUP BY frame", ("lo", "hi", "span"))
_scripted("script_functions", "a = max(coord_x(all)); b = max(coord_y(all)); v = {sqrt(a), cbrt(a), exp(-a), log(a), log2(a), log10(a), exp2(a / 10), sin(a), cos(a), atan(a), atan2(a, b), pow(a, 2), min(a, b), floor(a), ceil(a), abs(-a)};",
          f"m AS (SELECT frame, max(x) AS a, max(y) AS b FROM traj GROUP BY frame) SELECT {_FR}, " + ", ".join(f"round({e}, {_R}) AS c{i}" for i, e in enumerate(("sqrt(a)", "cbrt(a)", "exp(-a)", "ln(a)", "log2(a)", "log10(a)", "pow(2, a / 10)", "sin(a)", "cos(a)", "atan(a)", "atan2(a, b)", "a * a", "least(a, b)", "floor(a)", "ceil(a)", "a"))) + " FROM m", tuple(f"c{i}" for i in range(16)))
_scripted("script_vectors", "a = coord(:)[1, :]; b = coord(:)[2, :]; n = normalize(cross(a, b)); v = {dot(a, b), length(a), n[1], n[2], n[3]};",
          f"""p AS (SELECT a.frame, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS "by", b.z AS bz FROM traj a JOIN traj b USING (frame) WHERE a.atom_idx = 1 AND b.atom_idx = 2),
c AS (SELECT *, ay*bz-az*"by" AS cx, az*bx-ax*bz AS cy, ax*"by"-ay*bx AS cz FROM p)
SELECT {_FR}, round(ax*bx+ay*"by"+az*bz, {_R}) AS dot, round(sqrt(ax*ax+ay*ay+az*az), {_R}) AS length, round(cx/sqrt(cx*cx+cy*cy+cz*cz), {_R}) AS nx, round(cy/sqrt(cx*cx+cy*cy+cz*cz), {_R}) AS ny, round(cz/sqrt(cx*cx+cy*cy+cz*cz), {_R}) AS nz FROM c""", ("dot", "length", "nx", "ny", "nz"))
_scripted("script_distance_min", "v = min(distance_pair(element('N'), element('He')));", f"SELECT a.frame::INTEGER AS frame, round(min(sqrt({_d2('a', 'b')})), {_R}) AS value FROM traj a JOIN traj b ON a.frame = b.frame WHERE a.atom_idx IN (SELECT atom_idx FROM atoms WHERE element = 'N') AND b.atom_idx IN (SELECT atom_idx FROM atoms WHERE element = 'He') GROUP BY a.frame")
_scripted("script_count_levels", "s = within_x(0:5); v = {count(s), count(s, 'residue'), count(s, 'chain')};", f"""w AS (SELECT DISTINCT t.atom_idx, a.comp_idx, c.inst_idx FROM traj t JOIN atoms a ON t.atom_idx = a.atom_idx JOIN components c ON a.comp_idx = c.comp_idx WHERE frame = 0 AND x BETWEEN 0 AND 5),
n AS (SELECT count(DISTINCT atom_idx)::DOUBLE AS atoms, count(DISTINCT comp_idx)::DOUBLE AS residues, count(DISTINCT inst_idx)::DOUBLE AS chains FROM w) SELECT DISTINCT {_FR}, atoms, residues, chains FROM traj, n""", ("atoms", "residues", "chains"))
_scripted("script_transpose", "v = transpose(coord(1:3));", f"SELECT a.{_FR.replace('frame::', 'frame::')}, k AS i, round(CASE k WHEN 1 THEN a.x WHEN 2 THEN a.y ELSE a.z END, {_R}) AS a, round(CASE k WHEN 1 THEN b.x WHEN 2 THEN b.y ELSE b.z END, {_R}) AS b, round(CASE k WHEN 1 THEN c.x WHEN 2 THEN c.y ELSE c.z END, {_R}) AS c FROM traj a JOIN traj b ON a.frame = b.frame AND b.atom_idx = 2 JOIN traj c ON a.frame = c.frame AND c.atom_idx = 3, (SELECT unnest([1::BIGINT, 2, 3]) AS k) WHERE a.atom_idx = 1", ("a", "b", "c"))
_scripted("script_subscript", "v = coord(all)[2:3:, 2:3];", f"r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY atom_idx) AS k FROM traj) SELECT {_FR}, (k - 2) // 3 + 1 AS i, round(y, {_R}) AS y, round(z, {_R}) AS z FROM r WHERE k >= 2 AND (k - 2) % 3 = 0", ("y", "z"))
_scripted("script_field_arith", "f = rdf(element('C'), element('O'), 5.0); v = f * 2 + 1;", f"""q AS (SELECT a.frame, round(sqrt({_d2('a', 'b')}), 9) AS d FROM traj a JOIN traj b ON a.frame = b.frame AND a.atom_idx <> b.atom_idx
  JOIN atoms p ON p.atom_idx = a.atom_idx AND p.element = 'C' JOIN atoms o ON o.atom_idx = b.atom_idx AND o.element = 'O')
SELECT {_FR}, least(floor((d - 0.001) / {5.0 / 1024}), 1023)::BIGINT AS bin, (count(*) * 2 + 1)::DOUBLE AS value FROM q WHERE d >= 0.001 AND d <= 5.0 GROUP BY ALL""")
_scripted("script_nested_in", "v = (atom(1) in residue(:)) in residue(:);", "SELECT comp_idx::BIGINT AS group_id, min(atom_idx) AS atom_idx FROM atoms GROUP BY comp_idx")
_scripted("script_chain_rank", "v = chain(1:2);", """r AS (SELECT inst_idx, row_number() OVER (ORDER BY inst_idx) AS k FROM instances WHERE flags & 2 <> 0)
SELECT c.inst_idx::BIGINT AS group_id, atom_idx FROM atoms a JOIN components c ON a.comp_idx = c.comp_idx JOIN r ON c.inst_idx = r.inst_idx WHERE k <= 2""")
_scripted("script_within_in", "v = within(2.0) in residue(1:3);", f"""f AS (SELECT t.*, comp_idx FROM traj t JOIN (SELECT atom_idx, comp_idx FROM atoms) USING (atom_idx) WHERE frame = 0)
SELECT DISTINCT a.comp_idx::BIGINT AS group_id, b.atom_idx FROM f a JOIN f b ON a.comp_idx <> b.comp_idx WHERE a.comp_idx <= 3 AND {_d2('a', 'b')} <= 4.0""")
_scripted("script_out", "v = (out element('N')) in residue(1:2);", "SELECT c.comp_idx::BIGINT AS group_id, a.atom_idx FROM atoms a, (SELECT comp_idx FROM components WHERE comp_idx <= 2) c WHERE a.element = 'N'")
_scripted("script_density", "v = density(all);", " UNION ALL ".join(f"SELECT frame::INTEGER AS frame, '{c}' AS axis, least(floor(u / {_L / 1024}), 1023)::BIGINT AS bin, round(sum(mass) * {p.DENSITY} / {_L ** 3 / 1024}, {_R}) AS value FROM (SELECT frame, round({c} - {_L} * floor({c} / {_L}), 9) AS u, mass FROM (SELECT frame, atom_idx, {c} FROM traj) JOIN (SELECT atom_idx, mass FROM atoms) USING (atom_idx)) GROUP BY ALL" for c in "xyz").replace("SELECT", "qq AS (SELECT 1) SELECT", 1))


@_on_system("rdf_weights", f"""q AS (SELECT a.frame, round(sqrt({_d2('a', 'b')}), 9) AS d FROM traj a JOIN traj b ON a.frame = b.frame AND a.atom_idx <> b.atom_idx
  JOIN atoms p ON p.atom_idx = a.atom_idx AND p.element = 'C' JOIN atoms o ON o.atom_idx = b.atom_idx AND o.element = 'O'),
n AS (SELECT frame, least(floor((d - 0.001) / {5.0 / 64}), 63)::BIGINT AS bin, count(*) AS n FROM q WHERE d >= 0.001 AND d <= 5.0 GROUP BY ALL)
SELECT {_FR}, bin, n, round(sum(n) OVER (PARTITION BY frame) / (125.0::DOUBLE) * (pow((bin + 0.5) * {5.0 / 64}, 3) - CASE WHEN bin > 0 THEN pow((bin - 0.5) * {5.0 / 64}, 3) ELSE 0 END), {_R}) AS weight FROM n""")
def _rdf_weights(s: System) -> DataFrame:
    c, o = (s.trajectory.join(sel.atoms(s, F.col("element") == e), "atom_idx") for e in "CO")
    return p.rdf_weighted(c, o, s.cell, 5.0, 0.0, 64).select(F.col("frame").cast("int"), F.col("bin").cast("long"), "n", F.round("weight", _R).alias("weight"))


@_on_system("in_sphere", f"SELECT {_FR}, atom_idx FROM traj WHERE " + " + ".join(f"{_mi(f'{c} - 1')} * {_mi(f'{c} - 1')}" for c in "xyz") + " <= 16.0")
def _sphere(s: System) -> DataFrame:
    return spatial.in_sphere(s.trajectory, (1, 1, 1), 4.0, s.cell).select(F.col("frame").cast("int"), "atom_idx")


@_on_system("in_box", f"SELECT {_FR}, atom_idx FROM traj WHERE " + " AND ".join(f"abs({_mi(f'{c} - 1')}) <= {h}" for c, h in zip("xyz", (2, 3, 4), strict=True)))
def _box(s: System) -> DataFrame:
    return spatial.in_box(s.trajectory, (1, 1, 1), (2, 3, 4), s.cell).select(F.col("frame").cast("int"), "atom_idx")


@_on_system("selection_popcount", "SELECT count(*) AS n FROM atoms WHERE element = 'C' AND atom_idx BETWEEN 10 AND 300")
def _popcount(s: System) -> DataFrame:
    return sel.popcount(sel.atoms(s, F.col("element") == "C"), 10, 300)


@_on_system("selection_bitmap", "SELECT atom_idx FROM atoms WHERE element IN ('C', 'N')")
def _bitmap(s: System) -> DataFrame:
    return _keys(sel.deserialize(sel.serialize(sel.atoms(s, F.col("element").isin("C", "N")))))


_array_query("array_normalize", f"round(a[1] / sqrt(list_inner_product(a, a)), {_R}) AS value", lambda d: d.select("vec_id", F.round(F.element_at(arr.normalize(F.col("a")), 1), _R).alias("value")))
_array_query("matrix_mul", f"round(a[1]*a[5] + a[2]*a[7], {_R}) AS m11, round(a[3]*a[6] + a[4]*a[8], {_R}) AS m22, round(a[3]*a[5] + a[4]*a[6], {_R}) AS v2",
             lambda d: d.withColumns({"m": F.array(F.slice("a", 1, 2), F.slice("a", 3, 2)), "o": F.array(F.slice("a", 5, 2), F.slice("a", 7, 2))}).withColumns({"p": arr.matmul(F.col("m"), F.col("o")), "v": arr.matvec(F.col("m"), F.slice("a", 5, 2))}).select(
                 "vec_id", F.round(F.col("p")[0][0], _R).alias("m11"), F.round(F.col("p")[1][1], _R).alias("m22"), F.round(F.col("v")[1], _R).alias("v2")))

QUERIES["string_functions"] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/nation.parquet").select(
    "n_name", st.find(F.col("n_name"), "A").cast("long").alias("first"), st.find_last(F.col("n_name"), "A").cast("long").alias("last"), st.substring(F.col("n_name"), 1, 3).alias("part"), st.common_prefix(F.col("n_name"), F.lit("INDIANA")).cast("long").alias("prefix"),
    F.size(st.tokens(F.col("n_name"))).cast("long").alias("words"), st.equal(F.col("n_name"), F.lit("china"), ignore_case=True).alias("same"), st.matches_pattern(F.col("n_name"), "?R*").alias("pattern"), st.to_base64(F.col("n_name")).alias("base64"))
ORACLE_SQL["string_functions"] = """SELECT n_name, (instr(n_name, 'A') - 1)::BIGINT AS first, CASE WHEN instr(n_name, 'A') > 0 THEN length(n_name) - instr(reverse(n_name), 'A') ELSE -1 END::BIGINT AS last, substr(n_name, 2, 3) AS part,
(SELECT coalesce(max(k), 0) FROM (SELECT unnest(range(1, 8)) AS k) WHERE k <= length(n_name) AND substr(n_name, 1, k) = substr('INDIANA', 1, k))::BIGINT AS prefix, len(string_split(n_name, ' '))::BIGINT AS words, lower(n_name) = 'china' AS same,
n_name LIKE '_R%' AS pattern, base64(n_name::BLOB) AS base64 FROM nation"""
QUERIES["unit_convert"] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.round(units.convert(F.col("value"), units.parse("kJ/mol"), units.parse("eV/mol")) / 1e21, 6).alias("value"))
ORACLE_SQL["unit_convert"] = "SELECT event_id, round(value * 1000.0::DOUBLE / 1.602176634e-19 / 1e21, 6) AS value FROM events"


# --- imported tables and strings -------------------------------------------------------------------------------------
def _import_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table joined to frames by time, equal within a tolerance: an equi-join on buckets twice as wide, and their neighbours."""
    tol = 0.25
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.pmod(F.col("event_id"), F.lit(1000)) / 7.0).alias("time"), "value")
    f = spark.range(0, 21).select(F.col("id").alias("frame"), F.col("id").cast("double").alias("t"))
    e = e.withColumn("b", F.floor(F.col("time") / (2 * tol)))
    f = f.withColumn("b", F.explode(F.array(*[F.floor(F.col("t") / (2 * tol)) + i for i in (-1, 0, 1)])))
    return e.join(f, "b").filter(F.abs(F.col("time") - F.col("t")) <= tol).groupBy("frame").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


QUERIES["import_time_join"] = _import_join
ORACLE_SQL["import_time_join"] = """SELECT frame, count(*) AS n, round(avg(value), 4) AS mean FROM (SELECT (event_id % 1000) / 7.0::DOUBLE AS time, value FROM events) e
JOIN (SELECT unnest(range(0, 21)) AS frame) f ON abs(time - frame) <= 0.25 GROUP BY frame"""

QUERIES["levenshtein_suggest"] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name", F.levenshtein(F.lower("n_name"), F.lit("germny")).cast("long").alias("d")).orderBy("d", "n_name").limit(3)
ORACLE_SQL["levenshtein_suggest"] = "SELECT n_name, levenshtein(lower(n_name), 'germny') AS d FROM nation ORDER BY d, n_name LIMIT 3"


# --- structure: backbones, rings, hydrogen bonds, whole molecules ------------------------------------------------------
def _on_peptide(name: str, statement: str, recursive: bool = False) -> Callable:
    def add(build: Callable[[System], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: build(peptide(spark, sf_dir))
        ORACLE_SQL[name] = sql(f"{PEPTIDE_SQL}{'' if statement.lstrip().startswith('SELECT') else ','}\n{statement}", recursive)
        return build

    return add


_FULL = "(SELECT comp_idx FROM p_atoms GROUP BY comp_idx HAVING count(*) >= 4)"
_SEGMENTS = f"""full_comps AS (SELECT comp_idx, name, seq_id, seq_id - row_number() OVER (ORDER BY comp_idx) AS island FROM p_components WHERE comp_idx IN {_FULL}),
seg AS (SELECT *, count(*) OVER (PARTITION BY island) AS length, min(comp_idx) OVER (PARTITION BY island) AS range_id FROM full_comps)"""


def _dihedral_sql(a: str, b: str, c: str, d: str) -> str:
    """The angle from the projections of the outer bonds on the plane across the middle one."""
    u, v, w = ([_mi(f"{q}.{k} - {p}.{k}") for k in "xyz"] for p, q in ((a, b), (b, c), (c, d)))
    inner = lambda p, q: "(" + " + ".join(f"{x} * {y}" for x, y in zip(p, q, strict=True)) + ")"
    cross = lambda p, q: [f"({p[i]} * {q[j]} - {p[j]} * {q[i]})" for i, j in ((1, 2), (2, 0), (0, 1))]
    first, second = cross(u, v), cross(v, w)
    return f"atan2(sqrt({inner(v, v)}) * {inner(u, second)}, {inner(first, second)})"


@_on_peptide("backbone_segments", f"{_SEGMENTS} SELECT comp_idx, range_id, (comp_idx - range_id)::BIGINT AS segment FROM seg WHERE length >= 3")
def _segments(s: System) -> DataFrame:
    return structure.backbone_segments(s).select(F.col("comp_idx").cast("long"), F.col("range_id").cast("long"), F.col("segment").cast("long"))


@_on_peptide("backbone_angles", f"""{_SEGMENTS} SELECT b.frame::INTEGER AS frame, comp_idx, round({_dihedral_sql('a', 'b', 'c', 'd')}, {_R}) AS phi, round({_dihedral_sql('b', 'c', 'd', 'e')}, {_R}) AS psi
FROM seg JOIN traj b ON b.atom_idx = comp_idx * 5 - 4 JOIN traj a ON a.frame = b.frame AND a.atom_idx = comp_idx * 5 - 7 JOIN traj c ON c.frame = b.frame AND c.atom_idx = comp_idx * 5 - 3
JOIN traj d ON d.frame = b.frame AND d.atom_idx = comp_idx * 5 - 2 JOIN traj e ON e.frame = b.frame AND e.atom_idx = comp_idx * 5 + 1 WHERE length >= 4 AND comp_idx > range_id AND comp_idx < range_id + length - 1""")
def _angles(s: System) -> DataFrame:
    return structure.backbone_angles(s).select(F.col("frame").cast("int"), F.col("comp_idx").cast("long"), F.round("phi", _R).alias("phi"), F.round("psi", _R).alias("psi"))


@_on_peptide("ramachandran", f"""{_SEGMENTS} SELECT a.comp_idx, CASE WHEN b.name = 'PRO' THEN 'preproline' WHEN a.name = 'GLY' THEN 'glycine' WHEN a.name = 'PRO' THEN 'proline' ELSE 'general' END AS kind
FROM seg a LEFT JOIN seg b ON a.range_id = b.range_id AND b.comp_idx = a.comp_idx + 1 WHERE a.length >= 3""")
def _ramachandran(s: System) -> DataFrame:
    return structure.ramachandran(s).select(F.col("comp_idx").cast("long"), "kind")


def _angle_sql(u: list[str], v: list[str]) -> str:
    inner = lambda p, q: "(" + " + ".join(f"{x} * {y}" for x, y in zip(p, q, strict=True)) + ")"
    return f"acos(greatest(-1, least(1, {inner(u, v)} / sqrt({inner(u, u)} * {inner(v, v)}))))"


def _from_to(a: str, b: str) -> list[str]:
    return [_mi(f"{b}.{k} - {a}.{k}") for k in "xyz"]


@_on_peptide("backbone_bends", f"""{_SEGMENTS}, m AS (SELECT b.frame, comp_idx FROM seg JOIN traj a ON a.atom_idx = comp_idx * 5 - 13 JOIN traj b ON b.frame = a.frame AND b.atom_idx = comp_idx * 5 - 3
JOIN traj c ON c.frame = a.frame AND c.atom_idx = comp_idx * 5 + 7 WHERE length >= 3 AND comp_idx >= range_id + 2 AND comp_idx < range_id + length - 2 AND {_angle_sql(_from_to('a', 'b'), _from_to('b', 'c'))} > radians(70))
SELECT DISTINCT {_FR}, comp_idx + unnest([-2, -1, 0, 1, 2]) AS comp_idx FROM m""")
def _bends(s: System) -> DataFrame:
    return structure.bends(s).select(F.col("frame").cast("int"), F.col("comp_idx").cast("long"))


@_on_peptide("hydrogen_bonds", f"""e AS (SELECT i, j FROM p_bonds UNION SELECT j, i FROM p_bonds), deg AS (SELECT i, count(*) AS n FROM e GROUP BY i),
don AS (SELECT e.i AS donor, e.j AS hydrogen FROM e JOIN p_atoms a ON e.i = a.atom_idx JOIN p_atoms h ON e.j = h.atom_idx WHERE a.z IN (7, 8, 16) AND h.z = 1),
acc AS (SELECT atom_idx AS acceptor FROM p_atoms LEFT JOIN deg ON i = atom_idx WHERE z = 7 AND coalesce(n, 0) <= 3 OR z = 8 AND coalesce(n, 0) <= 2),
c AS (SELECT d.frame, donor, hydrogen, acceptor, {_angle_sql(_from_to('h', 'd'), _from_to('h', 'a'))} AS angle, sqrt({_d2('h', 'a')}) AS far FROM don JOIN traj d ON d.atom_idx = donor
JOIN traj h ON h.atom_idx = hydrogen AND h.frame = d.frame JOIN traj a ON a.frame = d.frame JOIN acc ON a.atom_idx = acceptor WHERE donor <> acceptor AND {_d2('d', 'a')} <= 25.0),
r AS (SELECT *, round(cos(pi() - angle) / far, 9) AS score FROM c WHERE angle > radians(120)),
best AS (SELECT *, row_number() OVER (PARTITION BY frame, hydrogen ORDER BY score DESC, acceptor) AS k FROM r),
kept AS (SELECT *, row_number() OVER (PARTITION BY frame, acceptor ORDER BY score DESC, hydrogen) AS m FROM best WHERE k = 1)
SELECT {_FR}, donor, hydrogen, acceptor, round(score, {_R}) AS score FROM kept WHERE m <= 2""")
def _hydrogen_bonds(s: System) -> DataFrame:
    return structure.hydrogen_bonds(s, 5.0, 120.0).select(F.col("frame").cast("int"), "donor", "hydrogen", "acceptor", F.round("score", _R).alias("score"))


# hexagons on every six atoms, with a bond across in every third
_HEXAGONS = "i, j FROM (SELECT atom_idx AS i, unnest(CASE (atom_idx - 1) % 6 WHEN 0 THEN CASE WHEN (atom_idx - 1) % 18 = 0 THEN [atom_idx + 1, atom_idx + 5, atom_idx + 3] ELSE [atom_idx + 1, atom_idx + 5] END WHEN 5 THEN []::BIGINT[] ELSE [atom_idx + 1] END) AS j FROM atoms) WHERE j IN (SELECT atom_idx FROM atoms)"


@_on_system("rings", f"""b AS (SELECT {_HEXAGONS}), ok AS (SELECT atom_idx FROM atoms a JOIN components c ON a.comp_idx = c.comp_idx WHERE c.flags & 393216 = 0),
e AS (SELECT i, j FROM (SELECT i, j FROM b UNION SELECT j, i FROM b) WHERE i IN (FROM ok) AND j IN (FROM ok)),
w AS (SELECT [i, j] AS path FROM e WHERE j > i UNION ALL SELECT list_append(path, e.j) FROM w JOIN e ON e.i = path[-1] WHERE len(path) < 6 AND e.j > path[1] AND NOT list_contains(path, e.j)),
c AS (SELECT path FROM w JOIN e ON e.i = path[-1] AND e.j = path[1] WHERE len(path) >= 3 AND path[2] < path[-1])
SELECT array_to_string(path, ',') AS ring, len(path)::BIGINT AS size FROM c WHERE (SELECT count(*) FROM e WHERE list_contains(path, e.i) AND list_contains(path, e.j)) = 2 * len(path)""", recursive=True)
def _rings(s: System) -> DataFrame:
    i = F.col("atom_idx")
    k = (i - 1) % 6
    to = F.when((i - 1) % 18 == 0, F.array(i + 1, i + 5, i + 3)).when(k == 0, F.array(i + 1, i + 5)).when(k < 5, F.array(i + 1))
    bonds = s.atoms.select(i.alias("i"), F.explode(to).alias("j")).join(s.atoms.select(i.alias("j")), "j", "left_semi").select("i", "j")
    return structure.rings(System(s.atoms, s.components, s.instances, bonds, s.trajectory, s.cell)).select(F.concat_ws(",", "ring").alias("ring"), F.col("size").cast("long"))


_HOPS = [f"round((n.{c} - t.{c}) / {_L})" for c in "xyz"]


@_on_system("unwrap", f"""h AS (SELECT t.frame, b.i, b.j, {", ".join(f"{h}::INTEGER AS h{c}" for h, c in zip(_HOPS, "xyz", strict=True))} FROM bonds b JOIN traj t ON t.atom_idx = b.i JOIN traj n ON n.frame = t.frame AND n.atom_idx = b.j),
w AS (SELECT frame, atom_idx, 0 AS sx, 0 AS sy, 0 AS sz FROM traj WHERE atom_idx NOT IN (SELECT j FROM bonds)
UNION ALL SELECT h.frame, h.j, sx - hx, sy - hy, sz - hz FROM w JOIN h ON h.frame = w.frame AND h.i = w.atom_idx)
SELECT w.frame::INTEGER AS frame, w.atom_idx, {", ".join(f"round({c} + s{c} * {_L}, {_R}) AS {c}" for c in "xyz")} FROM w JOIN traj t ON t.frame = w.frame AND t.atom_idx = w.atom_idx""", recursive=True)
def _unwrap(s: System) -> DataFrame:
    return structure.unwrap(s).select(F.col("frame").cast("int"), "atom_idx", *[F.round(c, _R).alias(c) for c in "xyz"])


@_on_system("morton_argsort", f"""p AS (SELECT atom_idx, x, y, z FROM traj WHERE frame = 0), b AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS ext FROM p),
k AS (SELECT atom_idx, {", ".join(f"floor(({c} - l{c}) / ext * 1023 + 0.5)::BIGINT AS {c}" for c in "xyz")} FROM p, b),
m AS (SELECT atom_idx, {" + ".join(f"((({c} >> {i}) & 1) << {3 * i + n})" for i in range(10) for n, c in enumerate("xyz"))} AS key FROM k)
SELECT atom_idx, row_number() OVER (ORDER BY key, atom_idx) - 1 AS position FROM m""")
def _morton_argsort(s: System) -> DataFrame:
    return structure.numbered(p.morton(s.trajectory.filter("frame = 0")), "key", "atom_idx").select("atom_idx", F.col("position").cast("long"))


@_on_peptide("instance_runs", """t AS (SELECT comp_idx, (comp_idx - 1) % 40 AS k FROM p_components), l AS (SELECT comp_idx, EXISTS (SELECT 1 FROM p_bonds WHERE (i - 1) // 5 + 1 = comp_idx - 1 AND (j - 1) // 5 + 1 = comp_idx AND k <> 0) AS stays FROM t),
r AS (SELECT comp_idx, max(CASE WHEN NOT stays THEN comp_idx END) OVER (ORDER BY comp_idx) AS inst_idx, count(CASE WHEN NOT stays THEN 1 END) OVER (ORDER BY comp_idx) - 1 AS n FROM l)
SELECT comp_idx, inst_idx, CASE WHEN n >= 702 THEN chr((n // 676 - 1)::INTEGER % 26 + 65) ELSE '' END || CASE WHEN n >= 26 THEN chr((n // 26 - 1)::INTEGER % 26 + 65) ELSE '' END || chr((n % 26)::INTEGER + 65) AS chain FROM r""")
def _instance_runs(s: System) -> DataFrame:
    # every fortieth residue begins a chain of its own
    of = F.floor((F.col("j") - 1) / 5)
    bonds = s.bonds.filter(~((of % 40 == 0) & (F.floor((F.col("i") - 1) / 5) != of)))
    return structure.instance_runs(System(s.atoms, s.components, s.instances, bonds, s.trajectory, s.cell)).select(F.col("comp_idx").cast("long"), F.col("inst_idx").cast("long"), "chain")


@_on_peptide("component_flags", f"SELECT comp_idx, CASE WHEN comp_idx IN {_FULL} THEN 512 ELSE 0 END AS flags FROM p_components")
def _component_flags(s: System) -> DataFrame:
    return structure.component_flags(s).select(F.col("comp_idx").cast("long"), "flags")


@_on_peptide("backbone_flags", f"SELECT atom_idx, CASE WHEN type IN ('N', 'CA', 'C') THEN 4 ELSE 0 END AS flags FROM p_atoms WHERE comp_idx IN {_FULL}")
def _backbone_flags(s: System) -> DataFrame:
    return structure.backbone_flags(s).select("atom_idx", "flags")


@_on_system("element_inference", "SELECT atom_idx, z AS by_mass, CASE type WHEN 'HE' THEN (CASE c.name WHEN 'PFT' THEN 1 ELSE 1 END) WHEN 'CA' THEN 6 ELSE z END AS by_label, element AS symbol FROM atoms a JOIN components c ON a.comp_idx = c.comp_idx")
def _elements(s: System) -> DataFrame:
    a = s.atoms.join(s.components.select("comp_idx", "name"), "comp_idx")
    return a.select("atom_idx", names.z_of_mass(F.col("mass")).alias("by_mass"), names.z_of_label(F.col("type"), F.col("name"), F.lit(10)).alias("by_label"), names.symbol_of_z(F.col("z")).alias("symbol"))


_on_system("residue_classes", "SELECT comp_idx, name = 'SOL' AS water, name IN ('LYS', 'ALA') AS amino, name = 'LYS' AS basic, name = 'ALA' AS hydrophobic FROM components")(
    lambda s: s.components.select("comp_idx", *[names.in_class(F.col("name"), kind).alias(alias) for kind, alias in (("water", "water"), ("amino_acid", "amino"), ("basic", "basic"), ("hydrophobic", "hydrophobic"))]))


# --- volumes -----------------------------------------------------------------------------------------------------------
_VOXELS = "SELECT vec_id AS id, vec_id % 8 AS ix, vec_id // 8 % 8 AS iy, vec_id // 64 AS iz, embedding[1]::DOUBLE AS value FROM embeddings"


def _voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), F.expr("vec_id % 8").alias("ix"), F.expr("vec_id div 8 % 8").alias("iy"), F.expr("vec_id div 64").alias("iz"), F.col("embedding")[0].cast("double").alias("value"))


_MANIFOLDS = "WITH RECURSIVE v AS ({voxels}), s AS (SELECT a.id, arg_{f}(b.id, (b.value, b.id)) AS nxt FROM v a JOIN v b ON abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 AND abs(a.iz - b.iz) <= 1 GROUP BY a.id), w AS (SELECT id, nxt FROM s UNION SELECT w.id, s.nxt FROM w JOIN s ON s.id = w.nxt), m AS (SELECT w.id, w.nxt AS top FROM w JOIN s ON s.id = w.nxt AND s.nxt = w.nxt) "
for _name, _f, _rising in (("manifold_ascending", "max", True), ("manifold_descending", "min", False)):
    QUERIES[_name] = lambda spark, sf_dir, rising=_rising: volumes.manifolds(_voxels(spark, sf_dir), rising)
    ORACLE_SQL[_name] = _MANIFOLDS.format(voxels=_VOXELS, f=_f) + "SELECT id, top FROM m"
QUERIES["extremum_sizes"] = lambda spark, sf_dir: volumes.extrema(_voxels(spark, sf_dir)).filter("kind = 'maximum'").select("id", "size")
ORACLE_SQL["extremum_sizes"] = _MANIFOLDS.format(voxels=_VOXELS, f="max") + "SELECT top AS id, count(*) AS size FROM m GROUP BY top"


@_on_system("gto_at_points", f"""o AS (SELECT x, y, z, 0.5 + atom_idx % 7 / 10.0::DOUBLE AS coeff, 0.2 + atom_idx % 3 / 2.0::DOUBLE AS alpha, atom_idx % 3 AS i, atom_idx % 2 AS j, atom_idx % 5 // 4 AS k, 2.0 + atom_idx % 2 AS cutoff FROM traj WHERE frame = 0),
q AS (SELECT atom_idx AS point, x, y, z FROM traj WHERE frame = 1)
SELECT point, round(coalesce(sum(coeff * pow(q.x - o.x, i) * pow(q.y - o.y, j) * pow(q.z - o.z, k) * exp(-alpha * ((q.x - o.x)**2 + (q.y - o.y)**2 + (q.z - o.z)**2))), 0), {_R}) AS value
FROM q LEFT JOIN o ON (q.x - o.x)**2 + (q.y - o.y)**2 + (q.z - o.z)**2 <= cutoff * cutoff GROUP BY point""")
def _gto(s: System) -> DataFrame:
    n = F.col("atom_idx")
    o = s.trajectory.filter("frame = 0").select("x", "y", "z", (0.5 + n % 7 / 10.0).alias("coeff"), (0.2 + n % 3 / 2.0).alias("alpha"), (n % 3).alias("i"), (n % 2).alias("j"), F.expr("atom_idx % 5 div 4").alias("k"), (2.0 + n % 2).alias("cutoff"))
    return volumes.evaluate(s.trajectory.filter("frame = 1").select(n.alias("point"), "x", "y", "z"), o).select("point", F.round("value", _R).alias("value"))


def _centre_sql(c: str) -> str:
    k = f"(2 * pi() / {_L})"
    m = f"atan2(sum(sin({c} * {k}) * radius), sum(cos({c} * {k}) * radius)) / {k}"
    return f"{m} - {_L} * floor({m} / {_L}) AS c{c}"


@_on_system("porosity", f"""q AS (SELECT frame, t.x, t.y, t.z, radius FROM traj t JOIN atoms a ON t.atom_idx = a.atom_idx WHERE element = 'C'), c AS (SELECT frame, {", ".join(map(_centre_sql, "xyz"))} FROM q GROUP BY frame),
p AS (SELECT q.frame, {", ".join(f"c{c} + {_mi(f'({c} - c{c})')} AS {c}" for c in "xyz")}, radius AS r FROM q JOIN c ON q.frame = c.frame),
b AS (SELECT frame, {", ".join(f"min({c} - r) AS l{c}, greatest(1.0, max({c} + r) - min({c} - r)) AS e{c}" for c in "xyz")} FROM p GROUP BY frame),
g AS (SELECT *, greatest(ex, ey, ez) / 48 AS v FROM b), h AS (SELECT *, {", ".join(f"ceil(round(e{c} / v, 9))::BIGINT AS n{c}" for c in "xyz")} FROM g),
near AS (SELECT p.*, h.* EXCLUDE (frame), {", ".join(f"unnest(range(greatest(0, floor(({c} - r - l{c}) / v)::BIGINT - 1), least(n{c}, floor(({c} + r - l{c}) / v)::BIGINT + 2))) AS ix" if c == "x" else f"range(greatest(0, floor(({c} - r - l{c}) / v)::BIGINT - 1), least(n{c}, floor(({c} + r - l{c}) / v)::BIGINT + 2)) AS r{c}" for c in "xyz")} FROM p JOIN h ON p.frame = h.frame),
n2 AS (SELECT *, unnest(ry) AS iy FROM near), n3 AS (SELECT *, unnest(rz) AS iz FROM n2),
f AS (SELECT frame, count(DISTINCT (ix, iy, iz)) AS full_n FROM n3 WHERE {" + ".join(f"(l{c} + (i{c} + 0.5) * v - {c})**2" for c in "xyz")} <= r * r GROUP BY frame)
SELECT h.frame::INTEGER AS frame, round(1 - full_n / (nx * ny * nz), {_R}) AS value FROM h JOIN f ON h.frame = f.frame""")
def _porosity(s: System) -> DataFrame:
    return volumes.porosity(s, sel.atoms(s, F.col("element") == "C"), 48).select(F.col("frame").cast("int"), F.round("value", _R).alias("value"))
