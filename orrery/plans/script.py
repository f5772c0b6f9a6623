"""Scripts: statements that bind values, selections and properties by frame.

``run(system, "d = distance(com(resname('LYS')), 1); {a, b} = {d, d * 2}")`` gives the names' values.  A number is a column:
without a DataFrame it is a constant, else the DataFrame has a row for each frame, each context (``ctx``, the groups on the
right of ``in``), and each place ``i`` of an array that grows with the data; arrays of fixed length are array columns.  A
field, which is a distribution or a volume, has a row for each bin or voxel that was met; all others hold ``rest``.
Selections are those of ``language``.  Nothing is evaluated before a result is read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegralType

from orrery.functions import arrays as arr
from orrery.functions import geometry as g
from orrery.functions import scalars
from orrery.operators import pairs as pairwise
from orrery.operators import properties as p
from orrery.operators import selection as sel
from orrery.operators import superposition, volumes
from orrery.plans.language import Call, LanguageError, Range, _Planner, parse_script
from orrery.schema import System

TIME_TOLERANCE = 1e-4
CONSTANTS = {"PI": math.pi, "TAU": 2 * math.pi, "E": math.e}


@dataclass(frozen=True)
class Number:
    """``value`` of ``df`` by ``keys``, or a constant column where there is no ``df``; ``depth`` counts the fixed array dimensions."""

    c: Column
    depth: int = 0
    whole: bool = False
    df: DataFrame | None = None
    keys: tuple[str, ...] = ()
    extreme: Callable[[bool], Number] | None = None  # the least or greatest of all rows, without the rows


@dataclass(frozen=True)
class Field:
    """``value`` at each of ``keys`` (the last ones are bins or voxels); ``rest`` at all places that have no row."""

    df: DataFrame
    keys: tuple[str, ...]
    rest: float = 0.0


@dataclass(frozen=True)
class Selection:
    """(ctx, group_id, atom_idx)."""

    df: DataFrame


Value = Number | Field | Selection | str | Range
#: Names whose calls are selections.
SELECTORS = frozenset("all ring ion backbone side sidechain nucleoside nucleobase type name label element atom protein nucleic nucleotide water resname residue component resid instance auth_id "
                      "chain_id chain within_x within_y within_z within_xyz within join split".split())


def _shape(kind: DataType) -> tuple[int, bool]:
    depth = 0
    while isinstance(kind, ArrayType):
        kind, depth = kind.elementType, depth + 1
    return depth, isinstance(kind, IntegralType)


def of_frame(df: DataFrame, *keys: str) -> Number:
    """A number from a DataFrame with ``value`` and the keys."""
    depth, whole = _shape(df.schema["value"].dataType)
    return Number(F.col("value"), depth, whole, df.select(*keys, "value"), keys)


def _deep(f: Callable[..., Column], depths: list[int]) -> Callable[..., Column]:
    """``f`` element by element; where depths differ, the shallower operand is used for each element."""
    top = max(depths)
    if not top:
        return f

    def run(*cs: Column) -> Column:
        inner = [d - 1 if d == top else d for d in depths]
        long = [i for i, d in enumerate(depths) if d == top]
        if len(long) == 1:
            return F.transform(cs[long[0]], lambda x: _deep(f, inner)(*[x if i == long[0] else c for i, c in enumerate(cs)]))
        return F.zip_with(cs[0], cs[1], lambda x, y: _deep(f, inner)(x, y))

    return run


def _rows(n: Number, spark) -> Number:
    """A fixed array as rows by place."""
    df = spark.range(1).select(n.c.alias("value")) if n.df is None else n.df
    return of_frame(df.select(*n.keys, F.posexplode("value").alias("i", "v")).select(*n.keys, (F.col("i") + 1).alias("i"), F.col("v").alias("value")), *n.keys, "i")


class _Evaluator:
    def __init__(self, system: System, frame: int = 0, tables: dict[str, DataFrame] | None = None):
        self.s, self.frame, self.tables, self.names = system, frame, tables or {}, {}
        self.spark = system.atoms.sparkSession

    # --- plumbing ---------------------------------------------------------------------------------------------------
    def apply(self, f: Callable[..., Column], *ns: Number, whole: bool = False, depth: int | None = None) -> Number:
        """``f`` element by element, or once for the whole values where ``depth`` tells that of the result."""
        if depth is None and len(ns) == 2 and any("i" in n.keys for n in ns):  # rows meet a fixed array
            inner = min(n.depth for n in ns if "i" in n.keys)
            ns = tuple(_rows(n, self.spark) if "i" not in n.keys and n.depth > inner else n for n in ns)
        op = f if depth is not None else _deep(f, [n.depth for n in ns])
        out_depth = max(n.depth for n in ns) if depth is None else depth
        dynamic = [n for n in ns if n.df is not None]
        if not dynamic:
            return Number(op(*[n.c for n in ns]), out_depth, whole)
        df, keys = None, ()
        columns: list[Column] = []
        for k, n in enumerate(ns):
            if n.df is None:
                columns.append(n.c)
                continue
            side = n.df.withColumnRenamed("value", f"_{k}")
            columns.append(F.col(f"_{k}"))
            if df is None:
                df, keys = side, n.keys
            else:
                common = [x for x in keys if x in n.keys]
                df = df.join(side, common) if common else df.join(side)
                keys = (*keys, *[x for x in n.keys if x not in keys])
        return replace(of_frame(df.select(*keys, op(*columns).alias("value")), *keys), whole=whole)

    def number(self, e, ctx) -> Number:
        v = self.value(e, ctx)
        if not isinstance(v, Number):
            raise LanguageError("a number expected")
        return v

    def planner(self, ctx) -> _Planner:
        return _Planner(self.s, self.frame, ctx, {k: v.df for k, v in self.names.items() if isinstance(v, Selection)})

    def selection(self, e, ctx) -> Selection:
        v = self.names.get(e.name) if isinstance(e, Call) and not e.args else None
        if isinstance(v, Number) and v.df is None and v.whole:  # whole numbers are atoms
            one = self.spark.range(1).select((F.explode(v.c) if v.depth else v.c).cast("long").alias(sel.KEY))
            return Selection(self.planner(ctx).universe.join(one, sel.KEY).select("ctx", F.lit(0).cast("long").alias("group_id"), sel.KEY))
        if isinstance(e, Call) and e.name == "{}" and all(isinstance(a, (int, Range)) for a in e.args):
            e = Call("atom", e.args)
        return Selection(self.planner(ctx).places(e))

    def points(self, e, ctx) -> DataFrame:
        """(frame, ctx, g, k, x, y, z, mass): the positions that an argument stands for, by group."""
        if isinstance(e, Call) and e.name not in SELECTORS and not (isinstance(self.names.get(e.name), Selection) or e.name in ("and", "or", "xor", "not", "out", "in", "flatten", "{}", ":")):
            v = self.number(e, ctx)
            if v.depth != 1:
                raise LanguageError("a position expected")
            df = self.s.trajectory.select("frame").distinct().join(self.spark.range(1).select(v.c.alias("value"))) if v.df is None else v.df
            key = F.col("i").cast("long") if "i" in v.keys else F.lit(0).cast("long")
            c = F.col("ctx") if "ctx" in v.keys else F.lit(0).cast("long")
            return df.select("frame", c.alias("ctx"), key.alias("g"), key.alias("k"), *[F.element_at("value", i + 1).alias(n) for i, n in enumerate("xyz")], F.lit(1.0).alias("mass"))
        found = self.selection(e, ctx).df.select("ctx", F.col("group_id").alias("g"), sel.KEY)
        t = self.s.trajectory.join(found, sel.KEY).join(self.s.atoms.select(sel.KEY, "mass"), sel.KEY)
        return t.select("frame", "ctx", "g", F.col(sel.KEY).alias("k"), "x", "y", "z", "mass")

    def centre(self, e, ctx) -> DataFrame:
        """(frame, ctx, x, y, z): the centre of mass; of several groups, the plain mean of their centres."""
        by = p.com_periodic(self.points(e, ctx), self.s.cell, ("frame", "ctx", "g"))
        return p.com_periodic(by.withColumn("mass", F.lit(1.0)), self.s.cell, ("frame", "ctx"))

    def positions(self, e, ctx) -> DataFrame:
        """(frame, ctx, k, x, y, z): all atoms of one group, or the centre of each of several."""
        t = self.points(e, ctx)
        several = isinstance(e, Call) and t.select("g").distinct().limit(2).count() > 1
        return p.com_periodic(t, self.s.cell, ("frame", "ctx", "g")).withColumnRenamed("g", "k") if several else t.select("frame", "ctx", "k", "x", "y", "z")

    def keyed(self, df: DataFrame, ctx, *more: str) -> Number:
        keys = ("frame", *(("ctx",) if ctx is not None else ()), *more)
        return of_frame(df.select(*keys, "value"), *keys)

    def ordered(self, df: DataFrame, ctx, *order: str) -> Number:
        """Rows numbered from 1 in each frame and context."""
        return self.keyed(df.withColumn("i", F.row_number().over(Window.partitionBy("frame", "ctx").orderBy(*order))), ctx, "i")

    # --- expressions ------------------------------------------------------------------------------------------------
    def value(self, e, ctx=None) -> Value:
        if isinstance(e, (str, Range)):
            return e
        if isinstance(e, (int, float)):
            return Number(F.lit(e if isinstance(e, int) else float(e)), 0, isinstance(e, int))
        name, args = e.name, e.args
        if not args and name in self.names:
            return self.names[name]
        if not args and name in CONSTANTS:
            return Number(F.lit(CONSTANTS[name]))
        if name == "in":
            return self.within_contexts(args[0], args[1], ctx)
        if name in scalars.BINARY or name in scalars.COMPARE:
            return self.binary(name, *[self.value(a, ctx) for a in args])
        if name == "neg":
            v = self.value(args[0], ctx)
            return replace(v, df=v.df.withColumn("value", -F.col("value")), rest=-v.rest) if isinstance(v, Field) else self.apply(lambda x: -x, v, whole=v.whole)
        if name in ("and", "or", "xor", "not"):
            return self.logical(name, args, ctx)
        if name == "{}":
            return self.array(args, ctx)
        if name == "[]":
            return self.subscript(self.value(args[0], ctx), args[1:])
        if name == "flatten":
            return self.flatten(args[0], ctx)
        if name == "transpose":
            return self.transpose(self.number(args[0], ctx))
        if name == "import":
            return self.table(args)
        if name in SELECTORS:
            return self.selection(e, ctx)
        if name == "out":
            try:
                return self.selection(e, ctx)
            except LanguageError:
                return self.value(args[0], None)
        found = getattr(self, f"do_{name}", None)
        if found:
            return found(ctx, *args)
        return self.function(name, [self.value(a, ctx) for a in args])

    def within_contexts(self, e, groups, ctx) -> Value:
        """Once for each group; numbers of all groups stand in a row, by group."""
        chosen = self.selection(groups, ctx)
        contexts = chosen.df.select((F.col("group_id") if ctx is None else F.struct("ctx", "group_id")).alias("ctx"), sel.KEY).distinct()
        if self.is_selection(e):
            return self.selection(Call("in", (e, groups)), ctx)
        v = self.value(e, contexts)
        if not isinstance(v, Number) or "ctx" not in v.keys:
            return v
        outer = F.col("ctx") if ctx is None else F.col("ctx.ctx")
        inner = F.col("ctx") if ctx is None else F.col("ctx.group_id")
        rows = v.df.select("frame", outer.alias("o"), inner.alias("n"), *(["i"] if "i" in v.keys else []), "value")
        w = Window.partitionBy("frame", *([] if ctx is None else ["o"])).orderBy("n", *(["i"] if "i" in v.keys else []))
        rows = rows.withColumn("i", F.row_number().over(w)).withColumnRenamed("o", "ctx")
        return self.keyed(rows, ctx, "i")

    def is_selection(self, e) -> bool:
        if not isinstance(e, Call):
            return isinstance(e, Range)
        if e.name in self.names:
            return isinstance(self.names[e.name], Selection)
        if e.name in ("and", "or", "xor", "not", "in", "out", "flatten", "{}"):
            return bool(e.args) and (e.name != "{}" or isinstance(e.args[0], Call)) and self.is_selection(e.args[0])
        return e.name in SELECTORS

    def logical(self, name: str, args: tuple, ctx) -> Value:
        if self.is_selection(args[0]):
            return self.selection(Call(name, args), ctx)
        ns = [self.number(a, ctx) for a in args]
        f = {"and": lambda a, b: a & b, "or": lambda a, b: a | b, "xor": lambda a, b: a != b, "not": lambda a: ~a}[name]
        return self.apply(f, *ns)

    def binary(self, op: str, a: Value, b: Value) -> Value:
        f = scalars.COMPARE.get(op) or scalars.BINARY[op]
        if isinstance(a, Field) or isinstance(b, Field):
            return self.fields(f, scalars.PLAIN[op], a, b)
        if not isinstance(a, Number) or not isinstance(b, Number):
            raise LanguageError(f"numbers expected around {op!r}")
        if op == "//" and not (a.whole and b.whole):
            raise LanguageError("whole numbers expected around '//'")
        return self.apply(f, a, b, whole=op in scalars.BINARY and op != "/" and a.whole and b.whole)

    def fields(self, f: Callable, plain: Callable[[float, float], float], a: Value, b: Value) -> Field:
        """Bin by bin or voxel by voxel; a field of several frames meets one number a frame, or a constant."""
        def rest(x: float, y: float) -> float:
            try:
                return plain(x, y)
            except ZeroDivisionError:
                return math.nan if not x or math.isnan(x) else math.copysign(math.inf, x)

        if isinstance(a, Field) and isinstance(b, Field):
            x, y = a.df.withColumnRenamed("value", "_a"), b.df.select(*b.keys, F.col("value").alias("_b"))
            both = x.join(y, list(a.keys), "full")
            extra = [c for c in a.df.columns if c not in (*a.keys, "value")]
            return Field(both.select(*a.keys, *extra, f(F.coalesce("_a", F.lit(a.rest)), F.coalesce("_b", F.lit(b.rest))).alias("value")), a.keys, rest(a.rest, b.rest))
        field, n, swapped = (a, b, False) if isinstance(a, Field) else (b, a, True)
        if not isinstance(n, Number) or n.df is not None or n.depth:
            raise LanguageError("a field takes a field or a constant")
        constant = float(self.spark.range(1).select(n.c.cast("double")).first()[0])
        g_ = (lambda x, y: f(y, x)) if swapped else f
        return replace(field, df=field.df.withColumn("value", g_(F.col("value"), F.lit(constant))), rest=rest(constant, field.rest) if swapped else rest(field.rest, constant))

    def array(self, args: tuple, ctx) -> Value:
        if not args:
            raise LanguageError("an item expected")
        if self.is_selection(args[0]) and isinstance(args[0], Call):
            return Selection(self.planner(ctx).plan(Call("{}", args)))
        if any(isinstance(a, Range) for a in args):
            raise LanguageError("ranges stand in arguments only")
        ns = [self.number(a, ctx) for a in args]
        if any("i" in n.keys for n in ns):  # rows after rows
            parts = [n if "i" in n.keys else _rows(replace(n, c=F.array(n.c), depth=n.depth + 1, df=None if n.df is None else n.df.withColumn("value", F.array("value"))), self.spark) for n in ns]
            keys = parts[0].keys
            both = reduce(lambda a, b: a.unionByName(b), [x.df.select(*keys, F.lit(k).alias("_k"), F.col("value").cast("double") if not x.depth else "value") for k, x in enumerate(parts)])
            w = Window.partitionBy(*[k for k in keys if k != "i"]).orderBy("_k", "i")
            return of_frame(both.withColumn("_n", F.row_number().over(w)).drop("i").withColumnRenamed("_n", "i"), *keys)
        whole = all(n.whole for n in ns)
        if len({n.depth for n in ns}) > 1:
            raise LanguageError("items of one kind expected")
        cast = lambda n: n if whole or n.depth else self.apply(lambda x: x.cast("double"), n)
        ns = [cast(n) for n in ns]
        return self.apply(lambda *cs: F.array(*cs), *ns, whole=whole, depth=ns[0].depth + 1)

    def subscript(self, v: Value, at: tuple) -> Value:
        if isinstance(v, Selection):
            if len(at) != 1:
                raise LanguageError("one subscript expected")
            first, last, step = self._bounds(at[0])
            rank = v.df.select("ctx", "group_id").distinct().withColumn("_n", F.row_number().over(Window.partitionBy("ctx").orderBy("group_id")))
            keep = (F.col("_n") >= first) & (F.col("_n") <= last if last else F.lit(True)) & (F.pmod(F.col("_n") - first, F.lit(step)) == 0)
            return Selection(v.df.join(rank.filter(keep).drop("_n"), ["ctx", "group_id"], "left_semi"))
        if not isinstance(v, Number):
            raise LanguageError("no subscripts here")
        if len(at) > v.depth + ("i" in v.keys):
            raise LanguageError("too many subscripts")
        if "i" in v.keys:
            first, last, step = self._bounds(at[0])
            df = v.df.filter((F.col("i") >= first) & (F.col("i") <= last if last else F.lit(True)) & (F.pmod(F.col("i") - first, F.lit(step)) == 0))
            if isinstance(at[0], int):
                keys = tuple(k for k in v.keys if k != "i")
                v = of_frame(df.select(*keys, "value"), *keys)
            else:
                v = of_frame(df.withColumn("i", ((F.col("i") - first) / step).cast("int") + 1), *v.keys)
            at = at[1:]
        if not at:
            return v
        for x in at:
            self._bounds(x)
        depth = v.depth - sum(isinstance(x, int) for x in at)
        return self.apply(lambda c: self._inner(c, at), v, whole=v.whole, depth=depth)

    def _inner(self, c: Column, at: tuple) -> Column:
        if not at:
            return c
        if isinstance(at[0], int):
            return self._inner(F.element_at(c, at[0]), at[1:])
        first, last, step = self._bounds(at[0])
        stop = F.size(c) if not last else F.least(F.size(c), F.lit(last))
        return F.transform(F.sequence(F.lit(first), stop, F.lit(step)), lambda i: self._inner(F.element_at(c, i), at[1:]))

    @staticmethod
    def _bounds(at) -> tuple[int, int | None, int]:
        if isinstance(at, int):
            at = Range(at, at)
        if not isinstance(at, Range) or at.first is not None and at.first < 1:
            raise LanguageError("subscripts are from 1")
        return int(at.first or 1), None if at.last is None else int(at.last), at.step

    def flatten(self, e, ctx) -> Value:
        if self.is_selection(e):
            return self.selection(Call("flatten", (e,)), ctx)
        v = self.number(e, ctx)
        while v.depth > ("i" not in v.keys):
            if "i" in v.keys:
                keys = tuple(k for k in v.keys if k != "i")
                df = v.df.select(*v.keys, F.posexplode("value").alias("_j", "_v"))
                w = Window.partitionBy(*keys).orderBy("i", "_j") if keys else Window.orderBy("i", "_j")
                v = of_frame(df.withColumn("_n", F.row_number().over(w)).select(*keys, F.col("_n").alias("i"), F.col("_v").alias("value")), *v.keys)
            else:
                v = self.apply(F.flatten, v, whole=v.whole, depth=v.depth - 1)
        return v

    def transpose(self, v: Number) -> Number:
        if "i" in v.keys and v.depth == 1:
            keys = tuple(k for k in v.keys if k != "i")
            df = v.df.select(*v.keys, F.posexplode("value").alias("_j", "_v")).groupBy(*keys, (F.col("_j") + 1).alias("j"))
            df = df.agg(F.array_sort(F.collect_list(F.struct("i", "_v"))).alias("_s")).select(*keys, F.col("j").alias("i"), F.col("_s")["_v"].alias("value"))
            return of_frame(df, *v.keys)
        if v.depth != 2:
            raise LanguageError("two dimensions expected")
        turned = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.element_at(c, 1))), lambda j: F.transform(c, lambda row: F.element_at(row, j)))
        return self.apply(turned, v, whole=v.whole, depth=2)

    def table(self, args: tuple) -> Number:
        """Rows of an imported table for each frame: by time where its first column is called so, else by their order."""
        if not args or args[0] not in self.tables:
            raise LanguageError("an imported table expected")
        t = self.tables[args[0]]
        names = t.columns
        chosen = [a if isinstance(a, str) else names[a - 1] for a in args[1:]] or [n for n in names if n.lower() not in ("time", "row")]
        unknown = [n for n in chosen if n not in names]
        if unknown:
            raise LanguageError(f"no column {unknown[0]!r}; near it: {', '.join(scalars.closest(unknown[0], names))}")
        frames = self.s.trajectory.select("frame").distinct()
        times = "frame" if self.s.frames is None else "time"
        frames = frames.withColumn("time", F.col("frame").cast("double")) if self.s.frames is None else frames.join(self.s.frames, "frame")
        value = F.array(*[F.col(c).cast("double") for c in chosen]) if len(chosen) > 1 else F.col(chosen[0]).cast("double")
        if names[0].lower() == "time":
            found = p.as_of(frames.select("frame", "time"), t.select(F.col(names[0]).cast("double").alias("t"), value.alias("value")), TIME_TOLERANCE)
        else:
            found = frames.join(t.withColumn("frame", F.col(names[0]).cast("int")).select("frame", value.alias("value")), "frame") if names[0].lower() == "row" else None
        if found is None:
            raise LanguageError("a table needs a first column Time or row")
        if frames.join(found, "frame", "left_anti").limit(1).count():
            raise LanguageError(f"not every frame has a row ({times})")
        return of_frame(found.select("frame", "value"), "frame")

    def function(self, name: str, vs: list[Value]) -> Value:
        if len(vs) == 1 and isinstance(vs[0], Field) and name == "abs":
            return replace(vs[0], df=vs[0].df.withColumn("value", F.abs("value")), rest=abs(vs[0].rest))
        if len(vs) == 2 and any(isinstance(v, Field) for v in vs) and name in ("min", "max"):
            return self.fields(F.least if name == "min" else F.greatest, min if name == "min" else max, *vs)
        if not vs or not all(isinstance(v, Number) for v in vs):
            raise LanguageError(f"no such function for these arguments: {name}")
        if len(vs) == 1 and name in ("min", "max") and (vs[0].depth or "i" in vs[0].keys):
            if vs[0].extreme:
                return vs[0].extreme(name == "max")
            v = self.flatten_number(vs[0])
            if "i" not in v.keys:
                return self.apply(F.array_min if name == "min" else F.array_max, v, whole=v.whole, depth=0)
            keys = [k for k in v.keys if k != "i"]
            return of_frame(v.df.groupBy(*keys).agg((F.min if name == "min" else F.max)("value").alias("value")), *keys)
        if len(vs) == 1 and name in scalars.UNARY:
            return self.apply(scalars.UNARY[name], vs[0], whole=name == "abs" and vs[0].whole)
        if len(vs) == 2 and name in scalars.PAIRS:
            return self.apply(scalars.PAIRS[name], *vs, whole=name in ("min", "max") and vs[0].whole and vs[1].whole)
        if name in ("vec2", "vec3", "vec4") and len(vs) == int(name[3]):
            return self.apply(lambda *cs: F.array(*[c.cast("double") for c in cs]), *vs, depth=1)
        if name in ("dot", "cross") and len(vs) == 2:
            return self.apply(arr.dot if name == "dot" else arr.cross, *vs, depth=0 if name == "dot" else 1)
        if name in ("length", "normalize") and len(vs) == 1:
            return self.apply(arr.length if name == "length" else arr.normalize, vs[0], depth=0 if name == "length" else 1)
        if name == "mul" and len(vs) == 2 and vs[0].depth == 2:
            return self.apply(arr.matmul if vs[1].depth == 2 else arr.matvec, *vs, depth=vs[1].depth)
        if name in ("int", "float") and len(vs) == 1:
            return self.apply(lambda c: c.cast("int" if name == "int" else "double"), vs[0], whole=name == "int")
        raise LanguageError(f"no such function: {name}")

    def flatten_number(self, v: Number) -> Number:
        while v.depth > 1 and "i" not in v.keys:
            v = self.apply(F.flatten, v, whole=v.whole, depth=v.depth - 1)
        if "i" in v.keys and v.depth:
            return _rows(replace(of_frame(v.df.drop("i"), *[k for k in v.keys if k != "i"])), self.spark)
        return v

    # --- properties -------------------------------------------------------------------------------------------------
    def do_com(self, ctx, e) -> Number:
        return self.keyed(self.centre(e, ctx).withColumn("value", F.array("x", "y", "z")), ctx)

    def do_distance(self, ctx, a, b) -> Number:
        x, y = (p.prefixed(self.centre(e, ctx), n, ("frame", "ctx")) for e, n in ((a, "a"), (b, "b")))
        return self.keyed(x.join(y, ["frame", "ctx"]).withColumn("value", g.norm(g.delta(g.vec("a"), g.vec("b"), self.s.cell))), ctx)

    def do_distance_pair(self, ctx, a, b) -> Number:
        points = [self.positions(e, ctx) for e in (a, b)]
        x, y = (p.prefixed(t, n, ("frame", "ctx"), ("k",)) for t, n in zip(points, "ab", strict=True))
        both = x.join(y, ["frame", "ctx"]).withColumn("value", F.sqrt(g.distance2(g.vec("a"), g.vec("b"), self.s.cell)))
        return replace(self.ordered(both, ctx, "ak", "bk"), extreme=lambda largest: self._extreme(ctx, *points, largest))

    def _extreme(self, ctx, x: DataFrame, y: DataFrame, largest: bool) -> Number:
        return self.keyed(pairwise.extreme(x, y, self.s.cell, largest, ("frame", "ctx")), ctx)

    def do_distance_min(self, ctx, a, b) -> Number:
        return self._extreme(ctx, self.positions(a, ctx), self.positions(b, ctx), False)

    def do_distance_max(self, ctx, a, b) -> Number:
        return self._extreme(ctx, self.positions(a, ctx), self.positions(b, ctx), True)

    def _joined(self, ctx, es) -> DataFrame:
        sides = [p.prefixed(self.centre(e, ctx), n, ("frame", "ctx")) for e, n in zip(es, "abcd", strict=False)]
        return reduce(lambda x, y: x.join(y, ["frame", "ctx"]), sides)

    def do_angle(self, ctx, a, b, c) -> Number:
        return self.keyed(self._joined(ctx, (a, b, c)).withColumn("value", g.angle(g.vec("a"), g.vec("b"), g.vec("c"))), ctx)

    def do_dihedral(self, ctx, a, b, c, d) -> Number:
        return self.keyed(self._joined(ctx, (a, b, c, d)).withColumn("value", g.dihedral([g.vec(n) for n in "abcd"], self.s.cell)), ctx)

    def do_coord(self, ctx, e, axes: str = "xyz") -> Number:
        value = F.array(*[F.col(c) for c in axes]) if len(axes) > 1 else F.col(axes)
        return self.ordered(self.positions(e, ctx).withColumn("value", value), ctx, "k")

    def do_coord_x(self, ctx, e) -> Number:
        return self.do_coord(ctx, e, "x")

    def do_coord_y(self, ctx, e) -> Number:
        return self.do_coord(ctx, e, "y")

    def do_coord_z(self, ctx, e) -> Number:
        return self.do_coord(ctx, e, "z")

    def do_coord_xy(self, ctx, e) -> Number:
        return self.do_coord(ctx, e, "xy")

    def do_coord_xz(self, ctx, e) -> Number:
        return self.do_coord(ctx, e, "xz")

    def do_coord_yz(self, ctx, e) -> Number:
        return self.do_coord(ctx, e, "yz")

    def do_count(self, ctx, e, level: str = "atom") -> Number:
        found = self.selection(e, ctx).df.select("ctx", sel.KEY).distinct()
        n = p.count_level(self.s, found, level)
        value = F.col("value").cast("double")
        frames = self.s.trajectory.select("frame").distinct()
        return self.keyed(frames.join(n.withColumn("value", value)), ctx) if ctx is not None else of_frame(frames.join(n).select("frame", value.alias("value")), "frame")

    def do_shape_weights(self, ctx, e) -> Number:
        t = p.shape_weights(self.points(e, ctx), ("frame", "ctx", "g"))
        return self.ordered(t.withColumn("value", F.array("linear", "planar", "isotropic")), ctx, "g")

    def do_plane(self, ctx, e) -> Number:
        return self.keyed(superposition.plane(self.positions(e, ctx), ("frame", "ctx")).withColumn("value", F.array("nx", "ny", "nz", "d")), ctx)

    def do_rmsd(self, ctx, e) -> Number:
        return self.keyed(superposition.rmsd(self.points(e, ctx), ("ctx",)), ctx)

    def do_porosity(self, ctx, e) -> Number:
        if ctx is not None:
            raise LanguageError("porosity stands outside of contexts")
        return self.keyed(volumes.porosity(self.s, self.selection(e, ctx).df.select(sel.KEY).distinct()), ctx)

    def do_rdf(self, ctx, a, b, radius) -> Field:
        if ctx is not None:
            raise LanguageError("rdf stands outside of contexts")
        low, high = (float(radius.first or 0.0), float(radius.last)) if isinstance(radius, Range) else (0.0, float(radius))
        x, y = (self.points(e, ctx).select("frame", F.col("k").alias(sel.KEY), "x", "y", "z") for e in (a, b))
        return Field(p.rdf_weighted(x, y, self.s.cell, high, low).withColumnRenamed("n", "value").withColumn("value", F.col("value").cast("double")), ("frame", "bin"))

    def _density(self, ctx, e, axis: str) -> Field:
        if ctx is not None:
            raise LanguageError("density stands outside of contexts")
        points = self.points(e, ctx).dropDuplicates(["frame", "k"])
        return Field(p.density(points, axis, self.s.cell).withColumn("weight", F.lit(1.0)), ("frame", "bin"))

    def do_density_x(self, ctx, e) -> Field:
        return self._density(ctx, e, "x")

    def do_density_y(self, ctx, e) -> Field:
        return self._density(ctx, e, "y")

    def do_density_z(self, ctx, e) -> Field:
        return self._density(ctx, e, "z")

    def do_density(self, ctx, e) -> Field:
        parts = [self._density(ctx, e, a).df.withColumn("axis", F.lit(a)) for a in "xyz"]
        return Field(reduce(lambda a, b: a.unionByName(b), parts), ("frame", "axis", "bin"))

    def do_sdf(self, ctx, refs, target, radius) -> Field:
        if ctx is not None:
            raise LanguageError("sdf stands outside of contexts")
        return Field(superposition.sdf(self.s, self.selection(refs, None).df, self.selection(target, None).df, float(radius)), ("frame", "ix", "iy", "iz"))

    def do_contact_count(self, ctx, a, b, cutoff, hops=4) -> Number:
        first, second = self.selection(a, ctx).df, self.selection(b, ctx).df
        if ctx is not None:
            raise LanguageError("contact_count stands outside of contexts")
        n = p.contacts(self.s, self.s.trajectory.join(first.select("group_id", sel.KEY), sel.KEY), self.s.trajectory.join(second.select(sel.KEY).distinct(), sel.KEY), float(cutoff), int(hops))
        groups = first.select("group_id").distinct().join(self.s.trajectory.select("frame").distinct())
        n = groups.join(n, ["frame", "group_id"], "left").select("frame", F.lit(0).cast("long").alias("ctx"), "group_id", F.coalesce("n", F.lit(0)).cast("double").alias("value"))
        return self.ordered(n, None, "group_id")


def run(system: System, text: str, frame: int = 0, tables: dict[str, DataFrame] | None = None) -> dict[str, Value]:
    """The values of a script's names; spatial predicates in selections look at one frame."""
    ev = _Evaluator(system, frame, tables)
    for names, e in parse_script(text):
        v = ev.selection(e, None) if ev.is_selection(e) and not isinstance(e, Range) else ev.value(e)
        again = [n for n in names if n in ev.names]
        if again:
            raise LanguageError(f"{again[0]!r} has a value already")
        if len(names) == 1:
            ev.names[names[0]] = v
        elif names:
            if not isinstance(v, Number) or not v.depth and "i" not in v.keys:
                raise LanguageError("nothing to take apart")
            inner = v.depth > 0  # the parts of each row, else the rows
            row = (ev.spark.range(1).select(v.c.alias("value")) if v.df is None else v.df).select(F.size("value") if inner else F.max("i").over(Window.partitionBy("frame"))).first()
            if row is not None and row[0] != len(names):
                raise LanguageError(f"{row[0]} names expected")
            for k, n in enumerate(names, 1):
                ev.names[n] = ev.subscript(v, (Range(None, None), k) if inner and "i" in v.keys else (k,))
    return ev.names


def table(value: Value, spark=None) -> DataFrame:
    """A value as a DataFrame: its keys and ``value``, or the atoms of a selection."""
    if isinstance(value, Selection):
        return value.df.select("group_id", sel.KEY)
    if isinstance(value, Field):
        return value.df
    if isinstance(value, Number):
        return value.df if value.df is not None else spark.range(1).select(value.c.alias("value"))
    raise LanguageError("no table of this")


def averaged(field: Field) -> DataFrame:
    """A field's mean over all frames, by bin or voxel; weights are averaged as well."""
    keys = [k for k in field.keys if k != "frame"]
    n = field.df.agg(F.count_distinct("frame").alias("_frames"))
    extra = [F.avg("weight").alias("weight")] if "weight" in field.df.columns else []
    total = field.df.groupBy(*keys).agg(F.sum("value").alias("_sum"), F.count("*").alias("_n"), *extra)
    return total.join(F.broadcast(n)).select(*keys, ((F.col("_sum") + (F.col("_frames") - F.col("_n")) * field.rest) / F.col("_frames")).alias("value"), *(["weight"] if extra else []))  # one row
