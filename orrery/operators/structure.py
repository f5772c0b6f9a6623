"""Structure that bonds and names tell: backbones, rings, hydrogen bonds, whole molecules, runs of components."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import geometry as g
from orrery.functions import names
from orrery.operators import pairs, properties
from orrery.schema import AMINO_ACID, BACKBONE, HETERO, ION, NUCLEOTIDE, POLYMER, SIDE_CHAIN, WATER, System

# fixed values: labels of the atoms of a residue's backbone
AMINO_LABELS = {"n": ("N",), "hn": ("HN",), "ca": ("CA",), "c": ("C",), "cb": ("CB",), "o": ("O", "O1", "OT1", "OC1")}
NUCLEIC_LABELS = {"p": ("P",), "o5": ("O5", "O5'", "O5*"), "c5": ("C5", "C5'", "C5*"), "c4": ("C4", "C4'", "C4*"), "c3": ("C3", "C3'", "C3*"), "o3": ("O3", "O3'", "O3*")}


def both_ways(bonds: DataFrame) -> DataFrame:
    """(i, j) in both directions, each once."""
    return bonds.select("i", "j").union(bonds.select(F.col("j").alias("i"), F.col("i").alias("j"))).filter("i <> j").distinct()


def _first_by_label(s: System, labels: dict[str, tuple[str, ...]]) -> DataFrame:
    found = [F.min(F.when(F.col("type").isin(*of), F.col("atom_idx"))).alias(role) for role, of in labels.items()]
    return s.atoms.groupBy("comp_idx").agg(*found, F.count("*").alias("_size"))


def amino_atoms(s: System) -> DataFrame:
    """(comp_idx, n, hn, ca, c, cb, o): atoms of residues of 4 atoms or more that have N, CA, C and O; hn and cb may be null."""
    return _first_by_label(s, AMINO_LABELS).filter("_size >= 4 AND n IS NOT NULL AND ca IS NOT NULL AND c IS NOT NULL AND o IS NOT NULL").drop("_size")


def nucleic_atoms(s: System) -> DataFrame:
    """(comp_idx, p, o5, c5, c4, c3, o3): atoms of residues that have all but P, which a first residue lacks."""
    return _first_by_label(s, NUCLEIC_LABELS).filter(" AND ".join(f"{c} IS NOT NULL" for c in NUCLEIC_LABELS if c != "p")).drop("_size")


def backbone_segments(s: System) -> DataFrame:
    """amino_atoms with (inst_idx, range_id, segment, length): runs of three or more residues of consecutive numbers in a polymer.

    A run is named by its first component; segments count from 0.
    """
    need = POLYMER | AMINO_ACID
    polymers = s.instances.filter(F.col("flags").bitwiseAND(need) == need).select("inst_idx")
    r = amino_atoms(s).join(s.components.select("comp_idx", "seq_id", "inst_idx"), "comp_idx").join(polymers, "inst_idx", "left_semi")
    w = Window.partitionBy("inst_idx").orderBy("comp_idx")
    new = (F.col("seq_id") != F.lag("seq_id").over(w) + 1) | (F.col("comp_idx") != F.lag("comp_idx").over(w) + 1)
    r = r.withColumn("_start", F.when(F.coalesce(new, F.lit(True)), F.col("comp_idx")))
    r = r.withColumn("range_id", F.last("_start", ignorenulls=True).over(w)).drop("_start", "seq_id")
    run = Window.partitionBy("inst_idx", "range_id")
    r = r.withColumns({"segment": F.row_number().over(run.orderBy("comp_idx")) - 1, "length": F.count("*").over(run)})
    return r.filter("length >= 3")


def backbone_angles(s: System) -> DataFrame:
    """(frame, comp_idx, phi, psi), in radians, of residues inside runs of four or more.

    Neighbours are found on the topology, once; the trajectory is then joined by atom only.
    """
    w = Window.partitionBy("inst_idx", "range_id").orderBy("segment")
    t = backbone_segments(s).withColumns({"a": F.lag("c").over(w), "e": F.lead("n").over(w)}).filter("length >= 4 AND a IS NOT NULL AND e IS NOT NULL")
    roles = {"a": "a", "b": "n", "c": "ca", "d": "c", "e": "e"}
    t = t.select("comp_idx", F.explode(F.array(*[F.struct(F.lit(role).alias("role"), F.col(c).alias("atom_idx")) for role, c in roles.items()])).alias("_r")).select("comp_idx", "_r.*")
    at = t.join(s.trajectory, "atom_idx").groupBy("frame", "comp_idx").agg(*[F.max(F.when(F.col("role") == role, F.col(c))).alias(f"{role}{c}") for role in roles for c in "xyz"])
    return at.select("frame", "comp_idx", g.dihedral([g.vec(r) for r in "abcd"], s.cell).alias("phi"), g.dihedral([g.vec(r) for r in "bcde"], s.cell).alias("psi"))


def ramachandran(s: System) -> DataFrame:
    """(comp_idx, kind): the class of each residue of a backbone; what stands before a proline is ``preproline``, whatever it is."""
    w = Window.partitionBy("inst_idx", "range_id").orderBy("segment")
    r = backbone_segments(s).join(s.components.select("comp_idx", "name"), "comp_idx").withColumn("_next", F.lead("name").over(w))
    kind = F.when(F.col("_next") == "PRO", "preproline").when(F.col("name") == "GLY", "glycine").when(F.col("name") == "PRO", "proline").otherwise("general")
    return r.select("comp_idx", kind.alias("kind"))


def bends(s: System, degrees: float = 70.0) -> DataFrame:
    """(frame, comp_idx) of residues within two of a place where the CA two before and two after leave it at more than an angle."""
    w = Window.partitionBy("inst_idx", "range_id").orderBy("segment")
    t = backbone_segments(s).withColumns({"a": F.lag("ca", 2).over(w), "e": F.lead("ca", 2).over(w), "near": F.array(*[F.col("comp_idx") + k for k in range(-2, 3)])}).filter("a IS NOT NULL AND e IS NOT NULL")
    p = {r: properties.prefixed(s.trajectory.withColumnRenamed("atom_idx", k), r, ["frame", k]) for r, k in (("a", "a"), ("b", "ca"), ("c", "e"))}
    t = t.select("near", "a", "ca", "e").join(p["a"], "a").join(p["b"], ["frame", "ca"]).join(p["c"], ["frame", "e"])
    u, v = g.delta(g.vec("a"), g.vec("b"), s.cell), g.delta(g.vec("b"), g.vec("c"), s.cell)
    turn = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), g.dot(u, v) / (g.norm(u) * g.norm(v)))))
    return t.filter(turn > math.radians(degrees)).select("frame", F.explode("near").alias("comp_idx")).distinct()


def rings(s: System) -> DataFrame:
    """(ring, size): rings of 3 to 6 atoms that no bond crosses, outside water and ions.

    A ring begins with its least atom and goes on to the lesser of its two neighbours.  Paths grow from each atom through
    greater ones only, so that each ring is met once; their number is bounded by the bonds that an atom has.
    """
    skip = s.components.filter(F.col("flags").bitwiseAND(WATER | ION) != 0).select("comp_idx")
    kept = s.atoms.join(skip, "comp_idx", "left_anti").select("atom_idx")
    edges = both_ways(s.bonds).join(kept.toDF("i"), "i", "left_semi").join(kept.toDF("j"), "j", "left_semi")
    edges = edges.select("i", "j")
    near = edges.groupBy("i").agg(F.collect_set("j").alias("near"))  # as many as an atom has bonds
    paths = near.select(F.array("i").alias("path"), F.col("near").alias("ends"), F.lit(False).alias("done"))
    step = near.toDF("_last", "_near")
    for size in range(2, 7):
        paths = paths.withColumn("_last", F.when(~F.col("done"), F.element_at("path", -1))).join(step, "_last", "left")
        more = F.transform(F.filter("_near", lambda j: (j > F.col("path")[0]) & ~F.array_contains("path", j)), lambda j: F.concat("path", F.array(j)))
        paths = paths.select(F.explode(F.when(F.col("done"), F.array("path")).otherwise(more)).alias("path"), "ends", "done")
        if size >= 3:
            closes = F.array_contains("ends", F.element_at("path", -1))
            paths = paths.withColumn("done", F.col("done") | closes).filter("size(path) < 3 OR NOT done OR path[1] < element_at(path, -1)")
    found = paths.filter("done").select("path")
    own = found.select("path", F.explode("path").alias("i")).join(edges, "i").filter(F.array_contains("path", F.col("j")))
    return own.groupBy("path").agg(F.count("*").alias("_n")).filter("_n = 2 * size(path)").select(F.col("path").alias("ring"), F.size("path").alias("size"))


def ring_atoms(s: System) -> DataFrame:
    """(group_id, atom_idx): the atoms of each ring; groups are named by a digest of the ring."""
    r = rings(s).select("ring", F.sha2(F.concat_ws(",", "ring"), 256).alias("group_id"))
    return r.select("group_id", F.explode("ring").alias("atom_idx"))


def donors(s: System) -> DataFrame:
    """(donor, hydrogen): N, O or S and each hydrogen that is bonded to it."""
    z = s.atoms.select("atom_idx", "z")
    e = both_ways(s.bonds).join(z.toDF("i", "zi"), "i").join(z.toDF("j", "zj"), "j")
    return e.filter("zi IN (7, 8, 16) AND zj = 1").select(F.col("i").alias("donor"), F.col("j").alias("hydrogen"))


def acceptors(s: System) -> DataFrame:
    """(acceptor, pairs): N and S with up to three bonds, O with up to two, and their lone pairs."""
    bonds = both_ways(s.bonds).groupBy("i").agg(F.count("*").alias("_n"))
    a = s.atoms.filter("z IN (7, 8, 16)").select(F.col("atom_idx").alias("i"), "z").join(bonds, "i", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    pairs = F.when(F.col("z") == 16, F.greatest(F.lit(0), 4 - F.col("_n"))).otherwise(2)
    return a.filter(F.col("_n") <= F.when(F.col("z") == 8, 2).otherwise(3)).select(F.col("i").alias("acceptor"), pairs.cast("int").alias("pairs"))


def hydrogen_bonds(s: System, reach: float = 3.0, degrees: float = 150.0) -> DataFrame:
    """(frame, donor, hydrogen, acceptor, score): each hydrogen's best acceptor, and of those as many as the acceptor has lone pairs.

    The donor lies within the reach (1 to 7) and the angle at the hydrogen exceeds the degrees (100 to 180), both across
    periodic borders.  Score: cosine of what the angle lacks, over the distance of hydrogen and acceptor.  Ties go to the
    least atom.
    """
    reach, degrees = min(7.0, max(1.0, reach)), min(180.0, max(100.0, degrees))
    d, a = donors(s), acceptors(s)
    at_donor = s.trajectory.join(d.select(F.col("donor").alias("atom_idx")).distinct(), "atom_idx", "left_semi")
    at_acceptor = s.trajectory.join(a.select(F.col("acceptor").alias("atom_idx")), "atom_idx", "left_semi")
    at_hydrogen = properties.prefixed(s.trajectory.withColumnRenamed("atom_idx", "hydrogen"), "h", ["frame", "hydrogen"])
    at_donor = at_donor.join(d.withColumnRenamed("donor", "atom_idx"), "atom_idx").join(at_hydrogen, ["frame", "hydrogen"])
    best = pairs.best_acceptors(at_donor, at_acceptor, reach, degrees, s.cell).filter("score > 0").join(a, "acceptor")
    rank = F.row_number().over(Window.partitionBy("frame", "acceptor").orderBy(F.desc("score"), "hydrogen", "donor"))
    return best.withColumn("_r", rank).filter("_r <= pairs").select("frame", "donor", "hydrogen", "acceptor", "score")


def unwrap(s: System) -> DataFrame:
    """(frame, atom_idx, x, y, z): each structure made whole across periodic borders, about its least atom.

    What spreads along bonds, and jumps over what is reached already, is the number of cells between an atom and its label,
    so rounds are about the logarithm of the longest path.  A structure that is bonded to its own image has no whole form;
    its atoms keep the shift found first.
    """
    properties.checkpoints(s.atoms.sparkSession)
    edges = both_ways(s.bonds).join(s.trajectory.select("frame", F.col("atom_idx").alias("i"), "x", "y", "z"), "i")
    edges = edges.join(properties.prefixed(s.trajectory.withColumnRenamed("atom_idx", "j"), "j", ["frame", "j"]), ["frame", "j"])
    hop = {f"h{c}": (-F.round((F.col(c) - F.col(f"j{c}")) / n) if n else F.lit(0.0)).cast("int") for c, n in zip("xyz", s.cell, strict=True)}
    edges = edges.withColumns(hop).select("frame", "i", "j", "hx", "hy", "hz").checkpoint()
    state = s.trajectory.select("frame", "atom_idx", F.struct(F.col("atom_idx").alias("label"), *[F.lit(0).alias(f"s{c}") for c in "xyz"]).alias("to"))
    add = lambda a, b, of: F.struct(b["label"].alias("label"), *[(a[f"{of}{c}"] + b[f"s{c}"]).alias(f"s{c}") for c in "xyz"])
    while True:
        seen = edges.join(state.withColumnRenamed("atom_idx", "j"), ["frame", "j"])
        seen = seen.groupBy("frame", F.col("i").alias("atom_idx")).agg(F.min(add({f"h{c}": F.col(f"h{c}") for c in "xyz"}, F.col("to"), "h")).alias("_near"))
        step = state.join(seen, ["frame", "atom_idx"], "left")
        step = step.select("frame", "atom_idx", F.col("to.label").alias("_old"), F.when(F.col("_near.label") < F.col("to.label"), F.col("_near")).otherwise(F.col("to")).alias("to")).checkpoint()
        far = step.select("frame", F.col("atom_idx").alias("_label"), F.col("to").alias("_far"))
        moved = step.withColumn("_label", F.col("to.label")).join(far, ["frame", "_label"])
        moved = moved.select("frame", "atom_idx", "_old", add(F.col("to"), F.col("_far"), "s").alias("to")).checkpoint()
        state = moved.select("frame", "atom_idx", "to")
        if not moved.filter("to.label <> _old").limit(1).count():
            break
    t = s.trajectory.join(state, ["frame", "atom_idx"])
    return t.select("frame", "atom_idx", *[(F.col(c) + F.col("to")[f"s{c}"] * float(n)).alias(c) for c, n in zip("xyz", s.cell, strict=True)])


def whole(s: System) -> System:
    """The system with whole structures, as superposition and spatial distributions want them; written once by checkpoint()."""
    return replace(s, trajectory=unwrap(s).checkpoint())


def numbered(df: DataFrame, *keys: str, name: str = "position") -> DataFrame:
    """Rows with their place in the order of the keys, from 0, without one task that sorts them all.

    The sorted parts are written by checkpoint() first, so that their borders stay; of each part only its size is gathered.
    """
    properties.checkpoints(df.sparkSession)
    parts = df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()).checkpoint()
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row for each part
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1
    return parts.join(before, "_part").withColumn(name, place + F.col("_before")).drop("_part", "_before")


def instance_runs(s: System) -> DataFrame:
    """(comp_idx, inst_idx, chain): runs of components, named by their first one.

    A component stays with the one before if both are of one kind and are bonded, or are water or ions of one name.  Runs
    are closed within parts of 2^17 components first; one row for each part then carries them over.
    """
    kinds = F.col("flags").bitwiseAND(HETERO | WATER | ION | AMINO_ACID | NUCLEOTIDE)
    c = s.components.select("comp_idx", "name", kinds.alias("kind"))
    of = s.atoms.select("atom_idx", "comp_idx")
    joined = both_ways(s.bonds).join(of.toDF("i", "a"), "i").join(of.toDF("j", "comp_idx"), "j").filter("a = comp_idx - 1").select("comp_idx").distinct().withColumn("_bonded", F.lit(True))
    before = c.select((F.col("comp_idx") + 1).alias("comp_idx"), F.col("name").alias("_name"), F.col("kind").alias("_kind"))
    c = c.join(before, "comp_idx", "left").join(joined, "comp_idx", "left")
    small = F.col("kind").bitwiseAND(WATER | ION) != 0
    stays = (F.col("kind") == F.col("_kind")) & ((small & (F.col("name") == F.col("_name"))) | F.coalesce("_bonded", F.lit(False)))
    c = c.select("comp_idx", F.when(~F.coalesce(stays, F.lit(False)), F.col("comp_idx")).alias("_start"), F.shiftright("comp_idx", 17).alias("_part"))
    inside = Window.partitionBy("_part").orderBy("comp_idx")
    c = c.withColumn("_run", F.last("_start", ignorenulls=True).over(inside))
    last = c.groupBy("_part").agg(F.max("_start").alias("_last"), F.count("_start").alias("_runs"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select("_part", F.max("_last").over(earlier).alias("_carried"), F.coalesce(F.sum("_runs").over(earlier), F.lit(0)).alias("_count"))
    number = F.count("_start").over(inside) + F.col("_count") - 1
    return c.join(last, "_part").select("comp_idx", F.coalesce("_run", "_carried").alias("inst_idx"), names.chain_id(number).alias("chain"))


def component_flags(s: System) -> DataFrame:
    """(comp_idx, flags): WATER, ION, AMINO_ACID, NUCLEOTIDE by name and atoms, beside HETERO as it is given."""
    sizes = s.atoms.groupBy("comp_idx").agg(F.count("*").alias("_n"), F.max("z").alias("_z"))
    c = s.components.join(sizes, "comp_idx", "left").join(amino_atoms(s).select("comp_idx", F.lit(True).alias("_amino")), "comp_idx", "left").join(nucleic_atoms(s).select("comp_idx", F.lit(True).alias("_nucleic")), "comp_idx", "left")
    name = F.col("name")
    amino = F.col("_amino").isNotNull() & names.in_class(name, "amino_acid")
    nucleic = F.col("_nucleic").isNotNull() & names.in_class(name, "nucleotide")
    flag = lambda test, bit: F.when(F.coalesce(test, F.lit(False)), bit).otherwise(0)
    found = [flag(names.in_class(name, "water") & F.col("_n").isin(1, 3), WATER), flag(names.in_class(name, "ion") & (F.col("_n") == 1), ION), flag(amino, AMINO_ACID), flag(nucleic, NUCLEOTIDE), F.coalesce(F.col("flags"), F.lit(0)).bitwiseAND(HETERO)]
    out: Column = found[0]
    for f in found[1:]:
        out = out.bitwiseOR(f)
    return c.select("comp_idx", out.alias("flags"))


def backbone_flags(s: System) -> DataFrame:
    """(atom_idx, flags): BACKBONE for N, CA and C, SIDE_CHAIN for all but these, O and HN, of amino acids."""
    a = s.atoms.select("atom_idx", "comp_idx").join(amino_atoms(s), "comp_idx")
    at = F.col("atom_idx")
    main, other = (at == F.col("n")) | (at == F.col("ca")) | (at == F.col("c")), (at == F.col("o")) | F.coalesce(at == F.col("hn"), F.lit(False))
    return a.select("atom_idx", F.when(main, BACKBONE).when(other, 0).otherwise(SIDE_CHAIN).alias("flags"))


def find_bond(bonds: DataFrame, i: int, j: int) -> DataFrame:
    """The bond of two atoms, in either order; empty if there is none."""
    return bonds.filter((F.least("i", "j") == min(i, j)) & (F.greatest("i", "j") == max(i, j)))


def insert_bonds(bonds: DataFrame, more: DataFrame) -> DataFrame:
    """(i, j), i < j, each once."""
    ordered = lambda b: b.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    return ordered(bonds).union(ordered(more)).filter("i <> j").distinct()


def remove_bonds(bonds: DataFrame, gone: DataFrame) -> DataFrame:
    ordered = lambda b: b.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    return ordered(bonds).join(ordered(gone), ["i", "j"], "left_anti")
