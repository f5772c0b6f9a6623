"""Readers of files that describe one system each: LAMMPS data, mmCIF, CUBE, GRO and PDB as systems, XYZ with a lattice.

Such a file is parsed whole by one task; many files are parsed in parallel.  Trajectories are in ``frames``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import names
from orrery.sources import text

_TOKEN = re.compile(r"""(?ms)^;(?P<block>.*?)^;|(?P<note>\#[^\n]*)|'(?P<single>(?:[^'\n]|'(?=\S))*)'(?=\s|\Z)|"(?P<double>(?:[^"\n]|"(?=\S))*)"(?=\s|\Z)|(?P<bare>\S+)""")


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")


# --- mmCIF -------------------------------------------------------------------------------------------------------------
def cif_items(body: str) -> Iterator[tuple[str, int, str, str]]:
    """(category, row, item, value) of items and loops; quotes and text blocks are taken off, ``.`` and ``?`` unquoted are left out."""
    def tokens() -> Iterator[tuple[bool, str]]:
        for m in _TOKEN.finditer(body):
            kind = m.lastgroup
            if kind == "bare":
                yield True, m["bare"]
            elif kind != "note":
                yield False, m[kind].strip("\n") if kind == "block" else m[kind]

    columns: list[str] = []
    naming, looped, cells = False, False, 0
    for bare, t in tokens():
        lower = t.lower() if bare else ""
        if lower == "loop_":
            columns, naming, looped, cells = [], True, True, 0
        elif lower.startswith(("data_", "save_")):
            columns, looped = [], False
        elif bare and t.startswith("_"):
            if not naming:
                columns, looped, cells = [], False, 0
            columns.append(t[1:])
        elif columns:
            naming = False
            row, k = divmod(cells, len(columns))
            category, _, item = columns[k].partition(".")
            if not bare or t not in (".", "?"):
                yield category, row, item, t
            cells += 1
            if not looped:
                columns = []


def read_cif(spark: SparkSession, path: str, category: str | None = None) -> DataFrame:
    """(file, category, row, item, value) of all categories or one."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part: list[tuple] = []
                for c, row, item, value in cif_items(body or ""):
                    if category is None or c == category:
                        part.append((file, c, row, item, value))
                    if len(part) == 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*part, strict=True)], names=["file", "category", "row", "item", "value"])
                        part = []
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*part, strict=True)], names=["file", "category", "row", "item", "value"])

    return _whole(spark, path).mapInArrow(parse, "file string, category string, row bigint, item string, value string")


def cif_table(spark: SparkSession, path: str, category: str, items: list[str]) -> DataFrame:
    """(file, row, items...) of one category; what a row lacks is null."""
    wide = read_cif(spark, path, category).filter(F.col("item").isin(*items)).groupBy("file", "row")
    return wide.agg(*[F.max(F.when(F.col("item") == i, F.col("value"))).alias(i) for i in items])


def read_mmcif(spark: SparkSession, path: str) -> DataFrame:
    """Atoms without other locations than A: (file, model, serial, name, res_name, chain_id, auth_id, res_seq, entity_id, x, y, z, element, is_hetatm)."""
    t = cif_table(spark, path, "atom_site", ["group_PDB", "id", "type_symbol", "label_atom_id", "label_alt_id", "label_comp_id", "label_asym_id", "label_entity_id", "label_seq_id", "auth_seq_id", "auth_asym_id", "Cartn_x", "Cartn_y", "Cartn_z", "pdbx_PDB_model_num"])
    t = t.filter("label_alt_id IS NULL OR label_alt_id = 'A'")
    return t.select("file", F.coalesce(F.col("pdbx_PDB_model_num").try_cast("int"), F.lit(1)).alias("model"), F.col("id").try_cast("int").alias("serial"), F.col("label_atom_id").alias("name"), F.col("label_comp_id").alias("res_name"),
                    F.col("label_asym_id").alias("chain_id"), F.col("auth_asym_id").alias("auth_id"), F.coalesce(F.col("label_seq_id").try_cast("int"), F.col("auth_seq_id").try_cast("int")).alias("res_seq"), F.col("label_entity_id").alias("entity_id"),
                    *[F.col(f"Cartn_{c}").try_cast("double").alias(c) for c in "xyz"], F.col("type_symbol").alias("element"), F.coalesce(F.col("group_PDB") == "HETATM", F.lit(False)).alias("is_hetatm"))


# --- LAMMPS data -------------------------------------------------------------------------------------------------------
# fixed values: the columns of each atom style
ATOM_STYLES = {"atomic": "id type x y z", "charge": "id type q x y z", "molecular": "id mol type x y z", "bond": "id mol type x y z", "angle": "id mol type x y z", "full": "id mol type q x y z", "dipole": "id type q x y z mux muy muz",
               "sphere": "id type diameter density x y z", "ellipsoid": "id type ellipsoidflag density x y z", "body": "id type bodyflag mass x y z", "dpd": "id type theta x y z", "electron": "id type q espin eradius x y z"}
_HEADS = ("Masses", "Atoms", "Bonds", "Angles", "Dihedrals", "Impropers", "Velocities", "Ellipsoids", "Bodies", "Pair Coeffs", "PairIJ Coeffs", "Bond Coeffs", "Angle Coeffs", "Dihedral Coeffs", "Improper Coeffs")


def lammps_sections(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, section, style, fields): rows of each section; ``style`` is what the comment beside a section's name says; the header is section ''."""
    head = rf"^({'|'.join(_HEADS)})\s*(#.*)?$"
    rows = text.lines(spark, path).withColumn("t", F.trim("line"))
    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    named = F.when(F.col("t").rlike(head), F.regexp_extract("t", head, 1))
    style = F.when(F.col("t").rlike(head), F.trim(F.regexp_replace(F.regexp_extract("t", head, 2), "#", "")))
    rows = rows.withColumns({"section": F.coalesce(F.last(named, ignorenulls=True).over(w), F.lit("")), "style": F.coalesce(F.last(style, ignorenulls=True).over(w), F.lit(""))})
    body = F.trim(F.regexp_replace("t", "#.*$", ""))
    return rows.filter((body != "") & ~F.col("t").rlike(head) & (F.col("n") > 0)).select("file", "n", "section", "style", F.split(body, r"\s+").alias("fields"))


def detect_style(style: str, fields: list[str]) -> str:
    """The atom style by its name beside the section, else by a row: columns to the left of three decimals, less three image numbers at the end."""
    if style.split(" ")[0] in ATOM_STYLES:
        return style.split(" ")[0]
    whole = [re.fullmatch(r"[+-]?\d+", f) is not None for f in fields]
    n = len(fields) - 3 if len(fields) >= 8 and all(whole[-3:]) else len(fields)
    if n == 5:
        return "atomic"
    if n == 6:
        return "molecular" if whole[2] else "charge"
    if n == 7:
        return "full" if whole[2] else "sphere"
    raise ValueError(f"name the atom style: a row has {len(fields)} columns")


def read_lammps_data(spark: SparkSession, path: str, style: str | None = None) -> dict[str, DataFrame]:
    """``atoms`` (file, atom_idx, type, element, z, mass, comp_idx, x, y, z...), ``bonds`` (file, i, j), i < j, and ``cell`` (file, lx, ly, lz, xy, xz, yz).

    Coordinates begin at the box's low corner; elements are told by masses.  All files are of one style: given, named in the
    file or told by a row, the only thing read ahead.
    """
    s = lammps_sections(spark, path)
    if style is None:
        one = s.filter("section = 'Atoms'").select("style", "fields").head(1)
        style = detect_style(one[0]["style"], one[0]["fields"]) if one else "atomic"
    at = {c: i for i, c in enumerate((ATOM_STYLES.get(style) or style).split())}
    bounds = s.filter("section = ''")
    pick = lambda key, k: F.max(F.when(F.concat_ws(" ", "fields").endswith(key), F.get("fields", F.lit(k)).try_cast("double")))
    cell = bounds.groupBy("file").agg(*[pick(f"{c}lo {c}hi", i).alias(f"{c}{n}") for c in "xyz" for i, n in enumerate(("lo", "hi"))], *[F.coalesce(pick("xy xz yz", i), F.lit(0.0)).alias(n) for i, n in enumerate(("xy", "xz", "yz"))])
    mass = s.filter("section = 'Masses'").select("file", F.col("fields")[0].cast("int").alias("type_id"), F.col("fields")[1].cast("double").alias("mass"))
    a = s.filter("section = 'Atoms'").select("file", *[F.get("fields", F.lit(at[c])).alias(f"_{c}") for c in ("id", "type", "x", "y", "z")], (F.get("fields", F.lit(at["mol"])) if "mol" in at else F.lit("1")).alias("_mol"))
    a = a.select("file", F.col("_id").cast("long").alias("atom_idx"), F.col("_type").cast("int").alias("type_id"), F.col("_mol").cast("int").alias("comp_idx"), *[F.col(f"_{c}").cast("double").alias(c) for c in "xyz"])
    a = a.join(cell, "file").join(mass, ["file", "type_id"], "left").withColumn("atomic", names.z_of_mass(F.col("mass")))
    a = a.select("file", "atom_idx", F.concat(F.lit("type_"), F.col("type_id")).alias("type"), names.symbol_of_z(F.col("atomic")).alias("element"), F.col("atomic"), "mass", "comp_idx", *[(F.col(c) - F.col(f"{c}lo")).alias(c) for c in "xyz"])
    b = s.filter("section = 'Bonds'").select("file", F.col("fields")[2].cast("long").alias("i"), F.col("fields")[3].cast("long").alias("j"))
    return {"atoms": a, "bonds": b.select("file", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")), "cell": cell.select("file", *[(F.col(f"{c}hi") - F.col(f"{c}lo")).alias(f"l{c}") for c in "xyz"], "xy", "xz", "yz")}


def lammps_radii(spark: SparkSession, path: str, form: str = "lj") -> DataFrame:
    """(file, type_id, radius) from pair coefficients: half of where the pair's energy is least, for ``lj`` (epsilon, sigma) or ``morse`` (d, a, r0)."""
    c = lammps_sections(spark, path).filter("section = 'Pair Coeffs'")
    value = lambda k: F.get("fields", F.lit(k)).try_cast("double")
    radius = {"lj": value(2) * (2 ** (1 / 6)) / 2, "morse": value(3) / 2}[form]
    return c.select("file", F.col("fields")[0].cast("int").alias("type_id"), radius.alias("radius"))


# --- CUBE --------------------------------------------------------------------------------------------------------------
_BOHR = 0.529177210903


def read_cube(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Grid (file, title, origin, axes, counts), atoms (file, atom_idx, z, charge, x, y, z) and values (file, ix, iy, iz, m, value); lengths in angstrom.

    A file that holds fewer values than its header says is refused.
    """
    fields = lambda n: F.expr(f"split(trim(rows[{n}]), '\\\\s+')")
    r = _whole(spark, path).withColumn("rows", F.split(F.regexp_replace("value", "\r", ""), "\n"))
    r = r.withColumns({"h": fields(2), "ax": fields(3), "ay": fields(4), "az": fields(5)}).withColumn("n", F.col("h")[0].cast("int"))
    number = lambda a: F.transform(F.slice(a, 2, 3), lambda v: v.cast("double"))
    # a negative count of points along the first axis says that lengths are in angstrom already
    r = r.withColumn("unit", F.when(F.col("ax")[0].cast("int") < 0, 1.0).otherwise(_BOHR))
    scaled = lambda a: F.transform(number(a), lambda v: v * F.col("unit"))
    r = r.withColumns({"origin": scaled("h"), "axes": F.array(scaled("ax"), scaled("ay"), scaled("az")), "counts": F.array(*[F.abs(F.col(a)[0].cast("int")) for a in ("ax", "ay", "az")]), "atoms": F.abs("n")})
    orbitals = F.when(F.col("n") < 0, F.split(F.trim(F.get("rows", F.col("atoms") + 6)), r"\s+"))
    r = r.withColumn("m", F.when(F.col("n") < 0, orbitals[0].cast("int")).otherwise(F.coalesce(F.get("h", F.lit(4)).try_cast("int"), F.lit(1))))
    r = r.withColumn("body", F.split(F.trim(F.array_join(F.slice("rows", F.col("atoms") + F.when(F.col("n") < 0, 1).otherwise(0) + 7, F.size("rows")), " ")), r"\s+"))
    # the orbitals' numbers may go on over more lines than one: they come before the values
    points = F.col("counts")[0] * F.col("counts")[1] * F.col("counts")[2] * F.col("m")
    extra = F.size("body") - points
    r = r.withColumn("body", F.when(extra >= 0, F.slice("body", extra + 1, points)).otherwise(F.raise_error(F.concat(F.col("file"), F.lit(": too few values")))))
    atoms = r.select("file", "unit", F.posexplode(F.slice("rows", 7, F.col("atoms"))).alias("k", "line")).withColumn("f", F.split(F.trim("line"), r"\s+"))
    atoms = atoms.select("file", (F.col("k") + 1).cast("long").alias("atom_idx"), F.col("f")[0].cast("int").alias("atomic"), F.col("f")[1].cast("double").alias("charge"), *[(F.col("f")[i + 2].cast("double") * F.col("unit")).alias(c) for i, c in enumerate("xyz")])
    v = r.select("file", "counts", "m", F.posexplode("body").alias("k", "t"))
    values = v.select("file", F.expr("k div (m * counts[2] * counts[1])").cast("int").alias("ix"), F.expr("k div (m * counts[2]) % counts[1]").cast("int").alias("iy"), F.expr("k div m % counts[2]").cast("int").alias("iz"), F.expr("k % m").cast("int").alias("m"), F.col("t").cast("double").alias("value"))
    return r.select("file", F.trim(F.col("rows")[0]).alias("title"), "origin", "axes", "counts"), atoms, values


# --- XYZ with a lattice, GRO boxes, PDB connections --------------------------------------------------------------------
def read_xyz_cells(spark: SparkSession, path: str) -> DataFrame:
    """(file, model, cell, kind) from the second line of each model: ``extended`` with Lattice="...", ``arc`` with six numbers, else ``plain`` and null."""
    rows = text.lines(spark, path)
    count = rows.filter("n = 0").select("file", F.regexp_extract("line", r"^\s*(\d+)", 1).try_cast("int").alias("atoms"))
    second = rows.join(count, "file").filter("atoms IS NOT NULL AND n % (atoms + 2) = 1")
    lattice = F.split(F.trim(F.regexp_extract("line", r'Lattice\s*=\s*["{]([^"}]*)["}]', 1)), r"[\s,]+")
    six = F.split(F.trim("line"), r"\s+")
    numbers = lambda a: F.transform(a, lambda v: v.try_cast("double"))
    arc = (F.size(six) == 6) & F.forall(numbers(six), lambda v: v.isNotNull())
    extended = F.col("line").rlike(r"Lattice\s*=|Properties\s*=")
    kind = F.when(extended, "extended").when(arc, "arc").otherwise("plain")
    cell = F.when(F.col("line").rlike(r"Lattice\s*="), numbers(lattice)).when(~extended & arc, numbers(six))
    return second.select("file", F.expr("n div (atoms + 2)").cast("int").alias("model"), cell.alias("cell"), kind.alias("kind"))


def read_gro_frames(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Atoms (file, frame, atom_idx, res_id, res_name, atom_name, x, y, z) and boxes (file, frame, title, box) of all frames, which have as many atoms as the first.

    Coordinates in angstrom; they may have any number of decimals, which the distance of the points in a line tells.
    """
    rows = text.lines(spark, path)
    count = rows.filter("n = 1").select("file", F.trim("line").try_cast("int").alias("atoms"))
    rows = rows.join(count, "file").withColumns({"frame": F.expr("n div (atoms + 3)").cast("int"), "at": F.expr("n % (atoms + 3)").cast("int")})
    tail = F.expr("substring(line, 21)")
    width = F.length(F.regexp_extract(tail, r"^[^.]*\.([^.]*)\.", 1)) + 1
    part = lambda i: (F.substring(tail, F.lit(1) + width * i, width).try_cast("double") * 10)
    atoms = rows.filter("at >= 2 AND at < atoms + 2").select("file", "frame", (F.col("at") - 1).cast("long").alias("atom_idx"), F.expr("try_cast(trim(substring(line, 1, 5)) AS int)").alias("res_id"), F.expr("trim(substring(line, 6, 5))").alias("res_name"),
                                                             F.expr("trim(substring(line, 11, 5))").alias("atom_name"), *[part(i).alias(c) for i, c in enumerate("xyz")])
    box = F.transform(F.split(F.trim("line"), r"\s+"), lambda v: v.try_cast("double") * 10)
    title = rows.filter("at = 0").select("file", "frame", F.col("line").alias("title"))
    return atoms, rows.filter("at = atoms + 2").select("file", "frame", box.alias("box")).join(title, ["file", "frame"]).select("file", "frame", "title", "box")


def read_pdb_connections(spark: SparkSession, path: str) -> DataFrame:
    """(file, i, j), i < j, of CONECT records, each once."""
    rows = text.lines(spark, path).filter(F.col("line").startswith("CONECT"))
    to = F.array(*[F.expr(f"try_cast(trim(substring(line, {k}, 5)) AS int)") for k in (12, 17, 22, 27)])
    rows = rows.select("file", F.expr("try_cast(trim(substring(line, 7, 5)) AS int)").alias("a"), F.explode(F.filter(to, lambda v: v.isNotNull())).alias("b"))
    return rows.select("file", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).distinct()


def read_pdb_structure(spark: SparkSession, path: str) -> DataFrame:
    """(file, kind, id, first_chain, first, last_chain, last) of HELIX and SHEET records."""
    rows = text.lines(spark, path).filter(F.col("line").rlike("^(HELIX|SHEET)"))
    helix = F.col("line").startswith("HELIX")
    at = lambda h, s, n, kind: F.when(helix, F.expr(f"try_cast(trim(substring(line, {h}, {n})) AS {kind})")).otherwise(F.expr(f"try_cast(trim(substring(line, {s}, {n})) AS {kind})"))
    return rows.select("file", F.when(helix, "helix").otherwise("sheet").alias("kind"), at(12, 12, 3, "string").alias("id"), at(20, 22, 1, "string").alias("first_chain"), at(22, 23, 4, "int").alias("first"), at(32, 33, 1, "string").alias("last_chain"), at(34, 34, 4, "int").alias("last"))


def number_components(atoms: DataFrame, order: str = "serial") -> DataFrame:
    """Atoms of models, as PDB and mmCIF readers give them, with ``comp_idx`` and ``inst_idx`` from 1: runs of one residue, and of one chain, in each file and model.

    Locations other than A are left out; elements that are not given are told by labels.
    """
    if "alt_loc" in atoms.columns:
        atoms = atoms.filter("alt_loc IS NULL OR alt_loc = 'A'").drop("alt_loc")
    w = Window.partitionBy("file", "model").orderBy(order)
    key = F.struct("res_name", "res_seq", "chain_id")
    new = lambda k: F.coalesce(~k.eqNullSafe(F.lag(k).over(w)), F.lit(True)) | (F.row_number().over(w) == 1)
    a = atoms.withColumns({"_c": new(key).cast("int"), "_i": new(F.struct("chain_id")).cast("int")})
    a = a.withColumns({"comp_idx": F.sum("_c").over(w), "inst_idx": F.sum("_i").over(w), "atom_idx": F.row_number().over(w)}).drop("_c", "_i")
    size = F.count("*").over(Window.partitionBy("file", "model", "comp_idx"))
    told = names.symbol_of_z(names.z_of_label(F.col("name"), F.col("res_name"), size))
    given = names.symbol_of_z(names.z_of_symbol(F.col("element")))
    return a.withColumn("element", F.coalesce(given, told))
