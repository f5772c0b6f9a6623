"""Units: exponents of eight base quantities and a scale.  They belong to columns, not to rows, so all is done at plan time."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from fractions import Fraction

from pyspark.sql import Column

# fixed values: the base quantities in order, SI prefixes, and named units as (exponents, scale)
BASE = ("length", "mass", "time", "current", "mole", "temp", "angle", "count")
PREFIXES = {"Y": 24, "Z": 21, "E": 18, "P": 15, "T": 12, "G": 9, "M": 6, "k": 3, "h": 2, "da": 1, "d": -1, "c": -2, "m": -3, "u": -6, "µ": -6, "n": -9, "p": -12, "f": -15, "a": -18}
NAMED: dict[str, tuple[dict[str, int], float]] = {
    "m": ({"length": 1}, 1.0), "g": ({"mass": 1}, 1e-3), "s": ({"time": 1}, 1.0), "A": ({"current": 1}, 1.0), "mol": ({"mole": 1}, 1.0), "K": ({"temp": 1}, 1.0), "rad": ({"angle": 1}, 1.0),
    "count": ({"count": 1}, 1.0), "Å": ({"length": 1}, 1e-10), "deg": ({"angle": 1}, 0.017453292519943295), "N": ({"mass": 1, "length": 1, "time": -2}, 1.0),
    "J": ({"mass": 1, "length": 2, "time": -2}, 1.0), "cal": ({"mass": 1, "length": 2, "time": -2}, 4.184), "eV": ({"mass": 1, "length": 2, "time": -2}, 1.602176634e-19),
    "W": ({"mass": 1, "length": 2, "time": -3}, 1.0), "Pa": ({"mass": 1, "length": -1, "time": -2}, 1.0), "bar": ({"mass": 1, "length": -1, "time": -2}, 1e5), "V": ({"mass": 1, "length": 2, "time": -3, "current": -1}, 1.0),
    "C": ({"current": 1, "time": 1}, 1.0), "Hz": ({"time": -1}, 1.0), "min": ({"time": 1}, 60.0), "h": ({"time": 1}, 3600.0), "L": ({"length": 3}, 1e-3), "u": ({"mass": 1}, 1.66053906660e-27),
}


@dataclass(frozen=True)
class Unit:
    exponents: tuple[Fraction, ...] = (Fraction(0),) * len(BASE)
    scale: float = 1.0

    def __mul__(self, other: Unit) -> Unit:
        return Unit(tuple(a + b for a, b in zip(self.exponents, other.exponents, strict=True)), self.scale * other.scale)

    def inverse(self) -> Unit:
        return Unit(tuple(-a for a in self.exponents), 1 / self.scale)

    def __truediv__(self, other: Unit) -> Unit:
        return self * other.inverse()

    def __pow__(self, n: int | Fraction) -> Unit:
        return Unit(tuple(a * n for a in self.exponents), self.scale ** float(n))

    def scaled(self, by: float) -> Unit:
        return replace(self, scale=self.scale * by)

    def __add__(self, other: Unit) -> Unit | None:
        """Sums and differences keep a unit only if both are the same."""
        return self if self.same(other) else None

    __sub__ = __add__

    def same(self, other: Unit) -> bool:
        return self.exponents == other.exponents and abs(self.scale / other.scale - 1) < 1e-9

    def factor(self, to: Unit) -> float:
        """What a value in this unit is multiplied by to be one in another."""
        if self.exponents != to.exponents:
            raise ValueError(f"no conversion from {self} to {to}")
        return self.scale / to.scale

    def __str__(self) -> str:
        for name, (of, scale) in NAMED.items():
            if self.same(_unit(of, scale)):
                return name
        one = {"length": "m", "mass": "kg", "time": "s", "current": "A", "mole": "mol", "temp": "K", "angle": "rad", "count": "count"}
        parts = [one[b] if n == 1 else f"{one[b]}^{n}" for b, n in zip(BASE, self.exponents, strict=True) if n]
        return ("" if abs(self.scale - 1) < 1e-12 else f"{self.scale:g} ") + "*".join(parts)


def _unit(of: dict[str, int], scale: float) -> Unit:
    return Unit(tuple(Fraction(of.get(b, 0)) for b in BASE), scale)


def _single(name: str) -> Unit:
    if name in NAMED:
        return _unit(*NAMED[name])
    for k in (2, 1):
        if name[:k] in PREFIXES and name[k:] in NAMED:
            return _unit(*NAMED[name[k:]]).scaled(10.0 ** PREFIXES[name[:k]])
    raise ValueError(f"no such unit: {name}")


def parse(text: str) -> Unit:
    """``kJ/mol``, ``m/s^2``, ``kg*m^2`` and the like; an empty text has no unit."""
    out, sign = Unit(), 1
    for op, name, power in re.findall(r"([*/·\s]*)([A-Za-zµÅ]+|1)(?:\^?(-?\d+))?", text.strip()):
        sign = -1 if "/" in op else 1
        if name != "1":
            out = out * _single(name) ** (sign * int(power or 1))
    return out


def from_label(label: str) -> Unit | None:
    """Of a column's label, in its last brackets."""
    m = re.search(r"\(([^()]*)\)\s*$", label)
    return parse(m[1]) if m else None


def convert(c: Column, unit: Unit, to: Unit) -> Column:
    return c * unit.factor(to)


def tagged(c: Column, name: str, unit: Unit) -> Column:
    """The column under a name, with its unit in the metadata."""
    return c.alias(name, metadata={"unit": str(unit), "scale": unit.scale, "exponents": [float(x) for x in unit.exponents]})
