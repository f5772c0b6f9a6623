"""Array arithmetic of the expression language, on JVM-side higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BINARY: dict[str, Callable[[Column, Column], Column]] = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b,
                                                        "<": lambda a, b: a < b, ">": lambda a, b: a > b}


def elementwise(op: str, a: Column, b: Column) -> Column:
    return F.zip_with(a, b, BINARY[op])


def with_scalar(op: str, a: Column, s: Column) -> Column:
    return F.transform(a, lambda x: BINARY[op](x, s))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Column, b: Column) -> Column:
    x = lambda i, j: a[i] * b[j] - a[j] * b[i]
    return F.array(x(1, 2), x(2, 0), x(0, 1))


def subscript(a: Column, first: int, last: int, step: int = 1) -> Column:
    """1-based, inclusive, strided."""
    if step < 1 or last < first:
        raise ValueError("a range ascends, by a positive step")
    return F.transform(F.sequence(F.lit(first), F.lit(last), F.lit(step)), lambda i: F.element_at(a, i))


def transpose(a: Column, columns: int) -> Column:
    def column(k: int) -> Column:
        return F.transform(a, lambda row: row[k])

    return F.array(*map(column, range(columns)))


def normalize(a: Column) -> Column:
    n = length(a)
    return F.transform(a, lambda x: F.when(n != 0, x / n).otherwise(F.lit(0.0)))


def matvec(m: Column, v: Column) -> Column:
    """Rows of ``m`` times ``v``."""
    return F.transform(m, lambda row: dot(row, v))


def matmul(a: Column, b: Column) -> Column:
    turned = F.transform(F.sequence(F.lit(1), F.size(F.element_at(b, 1))), lambda j: F.transform(b, lambda row: F.element_at(row, j)))
    return F.transform(a, lambda row: F.transform(turned, lambda column: dot(row, column)))
