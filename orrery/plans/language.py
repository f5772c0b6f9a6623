"""The selection language: an expression becomes a plan over a system's tables.

``filter_atoms(system, "element('C') and not within(3.0, resname('SOL'))")`` gives the keys of the atoms chosen, and ``select``
the groups.  Operators, the tightest first: subscripts, ``-`` and ``not``, ``* / //``, ``+ -``, comparisons, ``and``, ``xor``,
``or``, ``out``, ``in``; values and properties are in ``script``.  Ranges are ``a:b`` or ``a:step:b``, with
open ends; indices are from 1, inclusive, and relative to the context where there is one: in ``atom(1) in residue(:)`` the
left side is evaluated once for each group of the right.  Parsing happens on the driver; no data are touched by it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery import schema
from orrery.operators import selection as sel
from orrery.operators import spatial, structure
from orrery.schema import System

_TOKENS = re.compile(r"\s*(?:#[^\n]*\s*)*(?:(?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<word>[A-Za-z_]\w*)|(?P<string>'[^']*'|\"[^\"]*\")|(?P<sign>//|<=|>=|==|!=|[-+*/<>=(),:;{}\[\]]))")
_END = re.compile(r"\s*(?:#[^\n]*\s*)*$")


class LanguageError(ValueError):
    """The expression is not one of the language."""


@dataclass(frozen=True)
class Range:
    first: float | None
    last: float | None
    step: int = 1

    def holds(self, c: Column) -> Column:
        out = F.lit(True)
        if self.first is not None:
            out = out & (c >= self.first)
        if self.last is not None:
            out = out & (c <= self.last)
        return out & (F.pmod(c - int(self.first or 1), F.lit(self.step)) == 0) if self.step > 1 else out


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while not _END.match(text, at):
        m = _TOKENS.match(text, at)
        if not m:
            raise LanguageError(f"unexpected {text[at:at + 10]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Parser:
    """Operators from the loosest level to the tightest; subscripts bind tightest of all."""

    LEVELS = (("in",), ("out",), ("or",), ("xor",), ("and",), ("==", "!="), ("<", ">", "<=", ">="), ("+", "-"), ("*", "/", "//"), ("-", "not"))
    PREFIX = (1, 9)
    RESERVED = ("in", "out", "or", "xor", "and", "not")

    def __init__(self, text: str):
        self.rest = tokens(text)

    def peek(self, value: str) -> bool:
        return bool(self.rest) and self.rest[0][1] == value and self.rest[0][0] != "string"

    def take(self, *values: str) -> str | None:
        for value in values:
            if self.peek(value):
                self.rest.pop(0)
                return value
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise LanguageError(f"{value!r} expected" + (f" before {self.rest[0][1]!r}" if self.rest else ""))

    def whole(self):
        out = self.level(0)
        self.take(";")
        if self.rest:
            raise LanguageError(f"unexpected {self.rest[0][1]!r}")
        return out

    def script(self) -> list[tuple[tuple[str, ...], object]]:
        """(names, expression) of each statement; one name, or several in braces, or none."""
        out = []
        while self.rest:
            if self.take(";"):
                continue
            e, names = self.level(0), ()
            if self.take("="):
                targets = e.args if isinstance(e, Call) and e.name == "{}" else (e,)
                if not targets or not all(isinstance(t, Call) and not t.args and t.name.isidentifier() for t in targets):
                    raise LanguageError("a name expected on the left of '='")
                names, e = tuple(t.name for t in targets), self.level(0)
            if self.rest:
                self.need(";")
            out.append((names, e))
        return out

    def level(self, n: int):
        if n == len(self.LEVELS):
            return self.subscripted()
        if n in self.PREFIX:
            if n == 9 and self.peek("-") and len(self.rest) > 1 and self.rest[1][0] == "number":
                return self.subscripted()  # a negative number, maybe of a range
            op = self.take(*self.LEVELS[n])
            return Call("neg" if op == "-" else op, (self.level(n),)) if op else self.level(n + 1)
        out = self.level(n + 1)
        while op := self.take(*self.LEVELS[n]):
            out = Call(op, (out, self.level(n + 1)))
        return out

    def items(self, end: str) -> tuple:
        out = []
        while not self.take(end):
            if out:
                self.need(",")
            out.append(self.level(0))
        return tuple(out)

    def subscripted(self):
        out = self.primary()
        while self.take("["):
            out = Call("[]", (out, *self.items("]")))
        return out

    def number(self) -> float | int | None:
        minus = self.take("-")
        if self.rest and self.rest[0][0] == "number":
            x = self.rest.pop(0)[1]
            return (-1 if minus else 1) * (int(x) if x.isdigit() else float(x))
        if minus:
            raise LanguageError("a number expected")
        return None

    def primary(self):
        if self.take("("):
            out = self.level(0)
            self.need(")")
            return out
        if self.take("{"):
            return Call("{}", self.items("}"))
        if self.rest and self.rest[0][0] == "string":
            return self.rest.pop(0)[1][1:-1]
        if self.rest and self.rest[0][0] == "word" and self.rest[0][1] not in self.RESERVED:
            name = self.rest.pop(0)[1]
            return Call(name, self.items(")") if self.take("(") else ())
        first = self.number()
        if not self.take(":"):
            if first is None:
                raise LanguageError("an operand expected")
            return first
        second, step = self.number(), 1
        if self.take(":"):
            second, step = self.number(), second
        if step is None or step < 1 or first is not None and second is not None and second < first:
            raise LanguageError("a range ascends, by a positive step")
        return Range(first, second, step)


def parse(text: str):
    return _Parser(text).whole()


def to_json(text: str) -> str:
    """The statements of a script as JSON: names, and calls as [name, arguments..]."""
    def of(e):
        if isinstance(e, Range):
            return {"range": [e.first, e.step, e.last]}
        return [e.name, *map(of, e.args)] if isinstance(e, Call) else e

    return json.dumps([{"names": names, "value": of(e)} for names, e in parse_script(text)])


def parse_script(text: str) -> list[tuple[tuple[str, ...], object]]:
    return _Parser(text).script()


_FLAGGED = {"backbone": schema.BACKBONE, "side": schema.SIDE_CHAIN | schema.NUCLEOSIDE, "sidechain": schema.SIDE_CHAIN, "nucleoside": schema.NUCLEOSIDE, "nucleobase": schema.NUCLEOBASE}
_COMPONENTS = {"protein": schema.AMINO_ACID, "nucleic": schema.NUCLEIC_ACID, "nucleotide": schema.NUCLEOTIDE, "water": schema.WATER, "ion": schema.ION}


class _Planner:
    """Plans over a universe (ctx, atom_idx): one context of number 0, or the groups on the right of ``in``."""

    KEYS = ["ctx", sel.KEY]

    def __init__(self, system: System, frame: int, contexts: DataFrame | None = None, named: dict[str, DataFrame] | None = None):
        self.s, self.frame, self.relative, self.named = system, frame, contexts is not None, named or {}
        self.universe = contexts if self.relative else system.atoms.select(F.lit(0).cast("long").alias("ctx"), sel.KEY)

    def rows(self) -> DataFrame:
        return self.universe.join(self.s.atoms, sel.KEY)

    def owned(self) -> DataFrame:
        return self.rows().select(*self.KEYS, "comp_idx").join(self.s.components, "comp_idx")

    def ranked(self, rows: DataFrame, column: str) -> Column:
        """From 1 at the first of the context; gaps count."""
        return F.col(column) - F.min(column).over(Window.partitionBy("ctx")) + 1 if self.relative else F.col(column)

    def one(self, rows: DataFrame) -> DataFrame:
        return rows.select("ctx", F.lit(0).cast("long").alias("group_id"), sel.KEY).distinct()

    def any_of(self, args: tuple, column: str, index: Column | None = None) -> Column:
        def test(a) -> Column:
            if isinstance(a, str):
                return sel.matches(column, (a,))
            c = F.col(column) if index is None else index
            if isinstance(a, Range):
                return a.holds(c)
            if isinstance(a, (int, float)):
                return c == a
            raise LanguageError("strings, numbers or ranges expected")

        if not args:
            raise LanguageError("an argument expected")
        return reduce(lambda a, b: a | b, map(test, args))

    def by_index(self, rows: DataFrame, args: tuple, column: str) -> DataFrame:
        return rows.withColumn("_at", self.ranked(rows, column)).filter(self.any_of(args, "_at", F.col("_at")))

    def near(self, radius, reference: DataFrame) -> DataFrame:
        low, high = (radius.first or 0.0, radius.last) if isinstance(radius, Range) else (0.0, radius)
        if high is None:
            raise LanguageError("a radius expected")
        at = self.s.trajectory.filter(F.col("frame") == self.frame)
        place = lambda keys: keys.select(F.col("ctx").alias("frame"), sel.KEY).distinct().join(at.drop("frame"), sel.KEY)  # noqa: E731  each context is a frame of its own
        found = spatial.within(place(self.universe), place(reference), float(high), self.s.cell, float(low))
        return self.one(found.withColumnRenamed("frame", "ctx"))

    def near_context(self, radius) -> DataFrame:
        """All atoms near those of a context, without the context's own."""
        if not self.relative:
            raise LanguageError("within with one argument needs a context")
        low, high = (radius.first or 0.0, radius.last) if isinstance(radius, Range) else (0.0, radius)
        at = self.s.trajectory.filter(F.col("frame") == self.frame)
        pairs = spatial.range_join(at.join(self.universe.select(sel.KEY).distinct(), sel.KEY), at, float(high), self.s.cell).filter(F.col("d2") >= float(low) ** 2)
        found = pairs.select(F.col("i").alias(sel.KEY), "j").join(self.universe, sel.KEY).select("ctx", F.col("j").alias(sel.KEY)).distinct()
        return self.one(found.join(self.universe, self.KEYS, "left_anti"))

    def places(self, e) -> DataFrame:
        """A selection where bare indices are atoms."""
        return self.plan(Call("atom", (e,)) if isinstance(e, (int, Range)) else e)

    def plan(self, e) -> DataFrame:
        """(ctx, group_id, atom_idx)."""
        if not isinstance(e, Call):
            raise LanguageError("a selection expected")
        name, args = e.name, e.args
        if name in self.named and not args:
            found = self.named[name]
            return found.join(self.universe, self.KEYS, "left_semi") if not self.relative else found.select("group_id", sel.KEY).join(self.universe, sel.KEY).select("ctx", "group_id", sel.KEY)
        if name == "{}" and args:
            parts = [self.plan(a) for a in args]
            return reduce(lambda a, b: a.unionByName(b), [p.withColumn("group_id", F.col("group_id").cast("long") + F.lit(i << 40)) for i, p in enumerate(parts)])
        if name == "out":
            outer = _Planner(self.s, self.frame, named=self.named).plan(args[0]).select("group_id", sel.KEY)
            return self.universe.select("ctx").distinct().join(outer).select("ctx", "group_id", sel.KEY) if self.relative else outer.select(F.lit(0).cast("long").alias("ctx"), "group_id", sel.KEY)
        nested = [a for a in args if isinstance(a, Call)]
        if name in ("and", "or", "xor", "not"):
            parts = [self.one(self.plan(a)) for a in args]
            on = self.KEYS
            if name == "not":
                return self.one(self.universe.join(parts[0], on, "left_anti"))
            a, b = parts
            if name == "and":
                return a.join(b.select(*on), on, "left_semi").select("ctx", "group_id", sel.KEY)
            if name == "or":
                return a.unionByName(b).distinct()
            return a.join(b, on, "left_anti").unionByName(b.join(a, on, "left_anti")).select("ctx", "group_id", sel.KEY)
        if name == "in":
            groups = self.plan(args[1])
            contexts = groups.select(F.struct("ctx", "group_id").alias("ctx"), sel.KEY).distinct()
            found = _Planner(self.s, self.frame, contexts, self.named).plan(args[0])
            return found.select("ctx.ctx", "ctx.group_id", sel.KEY).distinct()
        if name in ("residue", "component", "chain") and nested:
            touched, column = self.one(self.plan(args[0])), "inst_idx" if name == "chain" else "comp_idx"
            owned = self.owned()
            return owned.join(owned.join(touched.select(*self.KEYS), self.KEYS, "left_semi").select("ctx", column).distinct(), ["ctx", column], "left_semi").select("ctx", F.col(column).cast("long").alias("group_id"), sel.KEY)
        if name in ("join", "flatten") and nested:
            return self.one(self.plan(args[0]))
        if name == "all":
            return self.one(self.universe)
        if name == "ring":  # what the context holds of each ring
            found = structure.numbered(structure.rings(self.s), "ring", name="group_id")
            return found.select(F.col("group_id").cast("long"), F.explode("ring").alias(sel.KEY)).join(self.universe, sel.KEY).select("ctx", "group_id", sel.KEY)
        if name in _FLAGGED:
            return self.one(self.rows().filter(F.col("flags").bitwiseAND(_FLAGGED[name]) != 0))
        if name in _COMPONENTS:
            found = self.owned().filter(F.col("flags").bitwiseAND(_COMPONENTS[name]) != 0).select("ctx", F.col("comp_idx").cast("long").alias("group_id"), sel.KEY)
            return self.one(found) if name == "ion" else found
        if name in ("type", "name", "label"):
            return self.one(self.rows().filter(self.any_of(args, "type")))
        if name == "element":
            return self.one(self.rows().filter(self.any_of(args, "element", F.col("z"))))
        if name == "atom":
            return self.one(self.by_index(self.rows(), args, sel.KEY))
        if name in ("resname", "residue", "component", "resid"):
            owned = self.owned()
            text = all(isinstance(a, str) for a in args)
            found = owned.filter(self.any_of(args, "name")) if text else owned.filter(self.any_of(args, "seq_id")) if name == "resid" else self.by_index(owned, args, "comp_idx")
            return found.select("ctx", F.col("comp_idx").cast("long").alias("group_id"), sel.KEY)
        if name in ("instance", "auth_id", "chain", "chain_id"):
            owned = self.owned().select(*self.KEYS, "inst_idx").join(self.s.instances, "inst_idx")
            if name.startswith("chain"):
                owned = owned.filter(F.col("flags").bitwiseAND(schema.POLYMER) != 0)
            text = all(isinstance(a, str) for a in args)
            if not text and name.startswith("chain"):  # by the rank among polymers
                owned = self.owned().select(*self.KEYS, "inst_idx").join(self.s.instances.filter(F.col("flags").bitwiseAND(schema.POLYMER) != 0).select("inst_idx"), "inst_idx")
                rank = owned.select("ctx", "inst_idx").distinct().withColumn("_at", F.row_number().over(Window.partitionBy("ctx").orderBy("inst_idx")))
                found = owned.join(rank.filter(self.any_of(args, "_at", F.col("_at"))), ["ctx", "inst_idx"], "left_semi")
            else:
                found = owned.filter(self.any_of(args, "auth_id" if name == "auth_id" else "id")) if text else self.by_index(owned, args, "inst_idx")
            return found.select("ctx", F.col("inst_idx").cast("long").alias("group_id"), sel.KEY)
        if name in ("within_x", "within_y", "within_z", "within_xyz"):
            axes = name[7:]
            if len(args) != len(axes) or not all(isinstance(a, Range) for a in args):
                raise LanguageError(f"{len(axes)} ranges expected")
            at = self.s.trajectory.filter(F.col("frame") == self.frame)
            at = at.filter(reduce(lambda a, b: a & b, (r.holds(F.col(c)) for c, r in zip(axes, args, strict=True))))
            return self.one(self.universe.join(at.select(sel.KEY), sel.KEY, "left_semi"))
        if name == "split" and len(args) == 2 and isinstance(args[1], int):
            one = self.one(self.plan(args[0]))
            w = Window.partitionBy("ctx")
            at = one.withColumns({"lo": F.min(sel.KEY).over(w), "n": F.max(sel.KEY).over(w) - F.min(sel.KEY).over(w) + 1})
            piece = F.expr(f"size(filter(sequence(1, {args[1] - 1}), i -> {sel.KEY} - lo >= n * i div {args[1]}))") if args[1] > 1 else F.lit(0)
            return at.select("ctx", (piece + 1).cast("long").alias("group_id"), sel.KEY)
        if name == "within" and len(args) == 1 and isinstance(args[0], (int, float, Range)):
            return self.near_context(args[0])
        if name == "within" and len(args) == 2:
            return self.near(args[0], self.places(args[1]))
        raise LanguageError(f"no such selection: {name}")


def select(system: System, text: str, frame: int = 0) -> DataFrame:
    """(group_id, atom_idx) of an expression; spatial predicates look at one frame."""
    return _Planner(system, frame).plan(parse(text)).select("group_id", sel.KEY)


def filter_atoms(system: System, text: str, frame: int = 0) -> DataFrame:
    """(atom_idx): the union of an expression's groups."""
    return sel.flatten(select(system, text, frame))
