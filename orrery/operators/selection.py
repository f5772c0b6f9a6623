"""Selections are relations of keys; selectors are filters, set algebra is joins that keep keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.schema import POLYMER, System

KEY = "atom_idx"


def matches(column: str, queries: tuple[str, ...]) -> Column:
    """Exact, ``prefix*``, ``*suffix``; a star at both ends matches all that is not empty."""

    def one(q: str) -> Column:
        c = F.col(column)
        if len(q) > 1 and q[0] == "*" == q[-1] or q == "*":
            return c != ""
        return c.endswith(q[1:]) if q.startswith("*") else c.startswith(q[:-1]) if q.endswith("*") else c == q

    return reduce(lambda a, b: a | b, map(one, queries))


def in_range(column: str, first: int | None, last: int | None, step: int = 1) -> Column:
    """Inclusive, strided from the first value, or from 1 where the start is open."""
    if step < 1 or first is not None and last is not None and last < first:
        raise ValueError("a range ascends, by a positive step")
    c, out = F.col(column), F.lit(True)
    if first is not None:
        out = out & (c >= first)
    if last is not None:
        out = out & (c <= last)
    return out & (F.pmod(c - (1 if first is None else first), F.lit(step)) == 0) if step > 1 else out


def atoms(s: System, predicate: Column | None = None) -> DataFrame:
    return (s.atoms if predicate is None else s.atoms.filter(predicate)).select(KEY)


def flagged(s: System, flags: int) -> DataFrame:
    return atoms(s, F.col("flags").bitwiseAND(flags) != 0)


def components(s: System, predicate: Column) -> DataFrame:
    """(group_id, atom_idx): one group for each component."""
    return s.atoms.select(KEY, "comp_idx").join(s.components.filter(predicate).select("comp_idx"), "comp_idx").select(F.col("comp_idx").alias("group_id"), KEY)


def instances(s: System, predicate: Column, polymer: bool = False) -> DataFrame:
    found = s.instances.filter(predicate & (F.col("flags").bitwiseAND(POLYMER) != 0) if polymer else predicate).select("inst_idx")
    return s.atoms.select(KEY, "comp_idx").join(s.components.select("comp_idx", "inst_idx").join(found, "inst_idx"), "comp_idx").select(F.col("inst_idx").alias("group_id"), KEY)


def flatten(groups: DataFrame) -> DataFrame:
    return groups.select(KEY).distinct()


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(KEY).union(b.select(KEY)).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, KEY, "left_semi").select(KEY).distinct()


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, KEY, "left_anti").select(KEY).distinct()


def symmetric(a: DataFrame, b: DataFrame) -> DataFrame:
    return subtract(a, b).union(subtract(b, a))


def complement(s: System, a: DataFrame) -> DataFrame:
    return subtract(atoms(s), a)


def split(sel: DataFrame, pieces: int) -> DataFrame:
    """(group_id from 1, atom_idx): pieces of the selection's span of indices."""
    span = sel.agg(F.min(KEY).alias("lo"), (F.max(KEY) - F.min(KEY) + 1).alias("n"))
    at = F.col(KEY) - F.col("lo")
    piece = F.expr(f"size(filter(sequence(1, {pieces - 1}), i -> {KEY} - lo >= n * i div {pieces}))") if pieces > 1 else F.lit(0)
    return sel.join(F.broadcast(span)).filter(at >= 0).select((piece + 1).cast("long").alias("group_id"), KEY)  # one row


def whole_components(s: System, sel: DataFrame) -> DataFrame:
    touched = s.atoms.join(sel, KEY, "left_semi").select("comp_idx").distinct()
    return s.atoms.join(touched, "comp_idx", "left_semi").select(F.col("comp_idx").alias("group_id"), KEY)


def whole_instances(s: System, sel: DataFrame) -> DataFrame:
    owned = s.atoms.select(KEY, "comp_idx").join(s.components.select("comp_idx", "inst_idx"), "comp_idx")
    return owned.join(owned.join(sel, KEY, "left_semi").select("inst_idx").distinct(), "inst_idx", "left_semi").select(F.col("inst_idx").alias("group_id"), KEY)


def grow_by_bonds(s: System, sel: DataFrame, depth: int) -> DataFrame:
    edges = s.bonds.select("i", "j").union(s.bonds.select(F.col("j").alias("i"), F.col("i").alias("j")))
    for _ in range(depth):
        sel = union(sel, edges.join(sel.withColumnRenamed(KEY, "i"), "i", "left_semi").select(F.col("j").alias(KEY)))
    return sel


def popcount(a: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """(n): the distinct atoms, in a range if asked for."""
    return a.filter(in_range(KEY, first, last)).agg(F.count_distinct(KEY).alias("n"))


def test_range(a: DataFrame, first: int, last: int) -> DataFrame:
    """(any, all): whether any and all atoms of a range are in the selection."""
    return popcount(a, first, last).select((F.col("n") > 0).alias("any"), (F.col("n") == last - first + 1).alias("all"))


def indices(a: DataFrame) -> DataFrame:
    """(atom_idx) in order."""
    return flatten(a).orderBy(KEY)


def content_hash(a: DataFrame) -> DataFrame:
    """(hash): the same for the same atoms, in whatever order and partitions."""
    return flatten(a).agg(F.coalesce(F.bit_xor(F.xxhash64(KEY)), F.lit(0)).alias("x"), F.count("*").alias("n")).select(F.xxhash64("x", "n").alias("hash"))


def serialize(a: DataFrame) -> DataFrame:
    """(bucket, bitmap): a bit for each atom, in bitmaps of fixed size; empty ones are left out."""
    at = F.col(KEY)
    return a.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"))


def deserialize(bitmaps: DataFrame) -> DataFrame:
    """(atom_idx) from ``serialize``."""
    size = 4096 * 8
    places = F.expr(f"""filter(sequence(0, {size - 1}), i -> (conv(hex(substring(bitmap, i div 8 + 1, 1)), 16, 10) div CAST(power(2, i % 8) AS INT)) % 2 = 1)""")
    return bitmaps.select("bucket", F.explode(places).alias("i")).select(((F.col("bucket") - 1) * size + F.col("i") + 1).alias(KEY))
