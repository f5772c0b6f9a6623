"""A molecular system over the driver's ``embeddings`` table, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.schema import System

FRAMES, SCALE, CELL = 21, 40.0, (20.0, 20.0, 20.0)
TYPES = (("H1", "H", 1, 1.008, 1.2), ("HE", "He", 2, 4.002602, 1.4), ("CA", "C", 6, 12.011, 1.7), ("N", "N", 7, 14.007, 1.55), ("O", "O", 8, 15.999, 1.52))
ATOM_FLAGS = (0x400, 0x2000, 0x4, 0x4, 0x4000)
NAMES, COMP_FLAGS = ("SOL", "LYS", "PFT", "ALA"), (0x20000, 0x200, 0x800, 0x40000)


def _pick(index, values, kind: str):
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int")).cast(kind)


def system(spark: SparkSession, sf_dir: str) -> System:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    t = F.col("vec_id") % 5
    atoms = e.select((F.col("vec_id") + 1).alias("atom_idx"), _pick(t, [x[0] for x in TYPES], "string").alias("type"), _pick(t, [x[1] for x in TYPES], "string").alias("element"),
                     _pick(t, [x[2] for x in TYPES], "int").alias("z"), _pick(t, [x[3] for x in TYPES], "double").alias("mass"), _pick(t, [x[4] for x in TYPES], "double").alias("radius"),
                     _pick(t, ATOM_FLAGS, "int").alias("flags"), (F.col("label") + 1).alias("comp_idx"))
    label = F.col("comp_idx") - 1
    components = atoms.select("comp_idx").distinct().select("comp_idx", _pick(label % 4, NAMES, "string").alias("name"), (F.lit(10) + label).cast("int").alias("seq_id"),
                                                            _pick(label % 4, COMP_FLAGS, "int").alias("flags"), (label % 3 + 1).cast("int").alias("inst_idx"))
    instances = spark.createDataFrame([(1, "A", "X", 0x2), (2, "B", "Y", 0), (3, "C", "Z", 0x2)], "inst_idx int, id string, auth_id string, flags int")
    w = Window.partitionBy("comp_idx").orderBy("atom_idx")
    bonds = atoms.select(F.col("atom_idx").alias("i"), F.lead("atom_idx").over(w).alias("j")).filter("j IS NOT NULL")
    x = F.col("embedding").cast("array<double>")
    frames = e.select((F.col("vec_id") + 1).alias("atom_idx"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(FRAMES - 1)), lambda f: F.struct(
        *[(F.element_at(x, f * 3 + k + 1) * SCALE).alias(c) for k, c in enumerate("xyz")]))).alias("frame", "p"))
    return System(atoms, components, instances, bonds, frames.select("frame", "atom_idx", "p.x", "p.y", "p.z"), CELL)


def _case(index: str, values) -> str:
    return f"(CASE {index} " + " ".join(f"WHEN {i} THEN {v!r}" for i, v in enumerate(values)) + " END)"


#: The same views for DuckDB: atoms, components, instances, bonds, traj.
SQL = f"""atoms AS (SELECT vec_id + 1 AS atom_idx, {_case('vec_id % 5', [x[0] for x in TYPES])} AS type, {_case('vec_id % 5', [x[1] for x in TYPES])} AS element,
  {_case('vec_id % 5', [x[2] for x in TYPES])} AS z, {_case('vec_id % 5', [x[3] for x in TYPES])}::DOUBLE AS mass, {_case('vec_id % 5', [x[4] for x in TYPES])}::DOUBLE AS radius,
  {_case('vec_id % 5', ATOM_FLAGS)} AS flags, label + 1 AS comp_idx FROM embeddings),
components AS (SELECT DISTINCT label + 1 AS comp_idx, {_case('label % 4', NAMES)} AS name, 10 + label AS seq_id, {_case('label % 4', COMP_FLAGS)} AS flags, label % 3 + 1 AS inst_idx FROM embeddings),
instances AS (SELECT * FROM (VALUES (1, 'A', 'X', 2), (2, 'B', 'Y', 0), (3, 'C', 'Z', 2)) v(inst_idx, id, auth_id, flags)),
bonds AS (SELECT * FROM (SELECT atom_idx AS i, lead(atom_idx) OVER (PARTITION BY comp_idx ORDER BY atom_idx) AS j FROM atoms) WHERE j IS NOT NULL),
traj AS (SELECT f.frame, vec_id + 1 AS atom_idx, embedding[3 * f.frame + 1]::DOUBLE * {SCALE} AS x, embedding[3 * f.frame + 2]::DOUBLE * {SCALE} AS y,
  embedding[3 * f.frame + 3]::DOUBLE * {SCALE} AS z FROM embeddings, (SELECT unnest(range(0, {FRAMES})) AS frame) f)"""


def sql(body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{SQL}{'' if body.lstrip().startswith('SELECT') else ','}\n{body}"


# a chain of residues of five atoms over the same table: N, CA, C, O and HN, with a gap in the numbers after every ten
PEPTIDE = (("N", "N", 7, 14.007, 1.55), ("CA", "C", 6, 12.011, 1.7), ("C", "C", 6, 12.011, 1.7), ("O", "O", 8, 15.999, 1.52), ("HN", "H", 1, 1.008, 1.2))
RESIDUES = ("ALA", "GLY", "PRO", "LYS")


def peptide(spark: SparkSession, sf_dir: str) -> System:
    s = system(spark, sf_dir)
    k, comp = (F.col("atom_idx") - 1) % 5, F.floor((F.col("atom_idx") - 1) / 5) + 1
    atoms = s.atoms.select("atom_idx", _pick(k, [x[0] for x in PEPTIDE], "string").alias("type"), _pick(k, [x[1] for x in PEPTIDE], "string").alias("element"), _pick(k, [x[2] for x in PEPTIDE], "int").alias("z"),
                           _pick(k, [x[3] for x in PEPTIDE], "double").alias("mass"), _pick(k, [x[4] for x in PEPTIDE], "double").alias("radius"), F.lit(0).alias("flags"), comp.cast("int").alias("comp_idx"))
    c = F.col("comp_idx")
    components = atoms.select("comp_idx").distinct().select("comp_idx", _pick(c % 4, RESIDUES, "string").alias("name"), (c + F.floor(c / 10)).cast("int").alias("seq_id"), F.lit(0x200).alias("flags"), F.lit(1).alias("inst_idx"))
    instances = spark.createDataFrame([(1, "A", "A", 0x202)], "inst_idx int, id string, auth_id string, flags int")
    hop = F.when(k == 0, F.array(F.lit(1), F.lit(4))).when(k == 1, F.array(F.lit(1))).when(k == 2, F.array(F.lit(1), F.lit(3))).otherwise(F.array().cast("array<int>"))
    bonds = atoms.select(F.col("atom_idx").alias("i"), F.explode(hop).alias("h")).select("i", (F.col("i") + F.col("h")).alias("j"))
    bonds = bonds.join(atoms.select(F.col("atom_idx").alias("j")), "j", "left_semi").select("i", "j")
    return System(atoms, components, instances, bonds, s.trajectory, CELL)


#: The same views for DuckDB: p_atoms, p_components, p_bonds.
PEPTIDE_SQL = f"""p_atoms AS (SELECT vec_id + 1 AS atom_idx, {_case('vec_id % 5', [x[0] for x in PEPTIDE])} AS type, {_case('vec_id % 5', [x[2] for x in PEPTIDE])} AS z, vec_id // 5 + 1 AS comp_idx FROM embeddings),
p_components AS (SELECT DISTINCT comp_idx, {_case('comp_idx % 4', RESIDUES)} AS name, comp_idx + comp_idx // 10 AS seq_id FROM p_atoms),
p_bonds AS (SELECT i, j FROM (SELECT atom_idx AS i, atom_idx + unnest(CASE (atom_idx - 1) % 5 WHEN 0 THEN [1, 4] WHEN 1 THEN [1] WHEN 2 THEN [1, 3] ELSE []::INTEGER[] END) AS j FROM p_atoms) WHERE j IN (SELECT atom_idx FROM p_atoms))"""
