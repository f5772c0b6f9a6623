"""String functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def equal(a: Column, b: Column, n: int | None = None, ignore_case: bool = False) -> Column:
    """Exact, or of the first ``n`` characters, in any case if asked for."""
    if n is not None:
        a, b = F.substring(a, 1, n), F.substring(b, 1, n)
    return F.lower(a) == F.lower(b) if ignore_case else a == b


def find(text: Column, part: str) -> Column:
    """The first place of a part, from 0; -1 if there is none."""
    return F.instr(text, F.lit(part)) - 1


def find_last(text: Column, part: str) -> Column:
    at = F.instr(F.reverse(text), F.lit(part[::-1]))
    return F.when(at > 0, F.char_length(text) - at - len(part) + 1).otherwise(-1)


def trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def substring(text: Column, start: int, n: int | None = None) -> Column:
    """From 0."""
    return F.substring(text, start + 1, 2**31 - 1 - start if n is None else n)


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading characters are equal."""
    n = F.least(F.char_length(a), F.char_length(b))
    first = F.array_position(F.zip_with(F.split(F.substring(a, F.lit(1), n), ""), F.split(F.substring(b, F.lit(1), n), ""), lambda x, y: x != y), True)
    return F.when(n == 0, 0).when(first > 0, first.cast("int") - 1).otherwise(n)


def tokens(text: Column, delimiter: str | None = None) -> Column:
    """Between runs of white space, or between delimiters."""
    if delimiter is None:
        return F.filter(F.split(text, r"\s+"), lambda x: x != "")
    return F.split(text, "\\Q" + delimiter + "\\E", -1)


def parse_float(text: Column) -> Column:
    """The leading number, exponents included; null if there is none."""
    return F.regexp_extract(trim(text), r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def parse_int(text: Column) -> Column:
    return F.regexp_extract(trim(text), r"^([+-]?\d+)", 1).try_cast("long")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./\\]*)$", 1)


def folder(path: Column) -> Column:
    """With the separator at its end."""
    return F.regexp_extract(path, r"^(.*[/\\])", 1)


def matches_pattern(text: Column, pattern: str) -> Column:
    """``*`` stands for any characters, ``?`` for one, ``#`` for a digit."""
    special = {"*": ".*", "?": ".", "#": "[0-9]"}
    return text.rlike("^" + "".join(special.get(c, "\\Q" + c + "\\E") for c in pattern) + "$")


def to_base64(data: Column) -> Column:
    return F.base64(data.cast("binary"))


def from_base64(text: Column) -> Column:
    return F.unbase64(text)


def hash64(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def hash32(*parts: Column) -> Column:
    return F.hash(*parts)
