"""Scalar functions of scripts, with the results that floating-point arithmetic has where SQL gives null or an error."""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAN = float("nan")


def _number(x: float) -> Column:
    return F.lit(float(x))


def divide(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    return F.when(b != 0, a / b).when(a.isNull() | b.isNull(), None).when((a == 0) | F.isnan(a), _number(_NAN)).otherwise(F.when(a > 0, _number("inf")).otherwise(_number("-inf")))


def divide_whole(a: Column, b: Column) -> Column:
    """Towards zero; null where the divisor is 0."""
    return F.when(b != 0, a / b).cast("int")


def _log(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(x > 0, f(x)).when(x == 0, _number("-inf")).when(x.isNotNull(), _number(_NAN))


UNARY: dict[str, Callable[[Column], Column]] = {
    "sqrt": F.sqrt, "cbrt": F.cbrt, "abs": F.abs, "floor": lambda x: F.floor(x).cast("double"), "ceil": lambda x: F.ceil(x).cast("double"), "cos": F.cos, "sin": F.sin, "asin": F.asin,
    "acos": F.acos, "atan": F.atan, "log": _log(F.ln), "exp": F.exp, "log2": _log(F.log2), "exp2": lambda x: F.pow(F.lit(2.0), x), "log10": _log(F.log10),
}
PAIRS: dict[str, Callable[[Column, Column], Column]] = {"atan": F.atan2, "atan2": F.atan2, "pow": F.pow, "min": F.least, "max": F.greatest}
BINARY: dict[str, Callable[[Column, Column], Column]] = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": divide, "//": divide_whole}
COMPARE: dict[str, Callable[[Column, Column], Column]] = {"<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge, "==": operator.eq, "!=": operator.ne}
PLAIN: dict[str, Callable] = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv, "//": operator.floordiv, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge,
                              "==": operator.eq, "!=": operator.ne}


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def closest(word: str, names: list[str], n: int = 3) -> list[str]:
    """The names nearest to a word by edit distance, for messages."""
    return sorted(names, key=lambda x: (edit_distance(word.lower(), x.lower()), x))[:n]
