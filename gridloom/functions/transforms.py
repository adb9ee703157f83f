"""Numbers, scales, units and missing values."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(text: str) -> float:
    """A decimal number or a ratio a/b."""
    parts = text.split("/")
    if len(parts) > 2:
        raise ValueError(f"not a number: {text}")
    try:
        value = float(parts[0]) / float(parts[1]) if len(parts) == 2 else float(parts[0])
    except (ValueError, ZeroDivisionError):
        raise ValueError(f"not a number: {text}") from None
    if not math.isfinite(value):
        raise ValueError(f"not a finite number: {text}")
    return value


@dataclass(frozen=True)
class Transform:
    """Scales and units of axes and fields, and a sentinel for missing values in packed form."""

    axis_scale: dict[str, float]
    axis_unit: dict[str, str]
    value_scale: tuple[float, ...] = ()
    value_unit: tuple[str, ...] = ()
    sentinel: float | None = None

    def scale_of(self, i: int, n: int) -> float:
        self._count(self.value_scale, n)
        return self.value_scale[i if len(self.value_scale) > 1 else 0] if self.value_scale else 1.0

    def unit_of(self, i: int, n: int, old: str | None = None) -> str | None:
        """A given unit; the old one only where the values stay as they are."""
        self._count(self.value_unit, n)
        if self.value_unit:
            return self.value_unit[i if len(self.value_unit) > 1 else 0]
        return old if self.scale_of(i, n) == 1 else None

    @staticmethod
    def _count(given: tuple, n: int) -> None:
        if given and len(given) not in (1, n):
            raise ValueError(f"{len(given)} scales or units for {n} fields")


NOTHING = Transform({}, {})


def parse_modifiers(text: str) -> Transform:
    """+x +y +z scales, +v value scales, +X +Y +Z +V units, +n sentinel. A + after e or E belongs to an exponent."""
    scale, unit, values, units, sentinel, seen = {}, {}, (), (), None, set()
    for part in re.split(r"(?<![eE])\+", text)[1:]:
        if len(part) < 2 or part[0] in seen:
            raise ValueError(f"empty, unknown or repeated modifier: +{part}")
        seen.add(part[0])
        kind, rest = part[0], part[1:]
        if kind in "xyz":
            scale[kind] = _scale(rest)
        elif kind in "XYZ":
            unit[kind.lower()] = rest
        elif kind == "v":
            values = tuple(map(_scale, rest.split(",")))
        elif kind == "V":
            units = tuple(rest.split(","))
        elif kind == "n":
            sentinel = number(rest)
        else:
            raise ValueError(f"unknown modifier: +{part}")
    return Transform(scale, unit, values, units, sentinel)


def _scale(text: str) -> float:
    value = number(text)
    if value == 0:
        raise ValueError("a scale must not be zero")
    return value


@dataclass(frozen=True)
class Source:
    """path?field1,field2+modifiers"""

    path: str
    fields: tuple[str, ...]
    transform: Transform


def parse_source(text: str) -> Source:
    path, _, rest = text.partition("?")
    cut = re.search(r"(?<![eE])\+", rest)
    names = rest[: cut.start()] if cut else rest
    fields = tuple(n for n in names.split(",") if n)
    if len(set(fields)) != len(fields):
        raise ValueError(f"a field is named twice: {text}")
    return Source(path, fields, parse_modifiers(rest[cut.start() :]) if cut else NOTHING)


def finite(v: Column) -> Column:
    """v where it is a finite number, else null."""
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), v)


def unpack(packed: Column, scale_factor: float = 1.0, add_offset: float = 0.0, missing: tuple[float, ...] = (), user_scale: float = 1.0) -> Column:
    """Missing values are told by the packed value; what is left is unpacked and scaled."""
    v = packed.cast("double")
    # Float columns hold the sentinel rounded to float.
    gone = [packed == F.lit(m).cast("double") for m in missing] + [v == F.lit(m).cast("float").cast("double") for m in missing]
    kept = v
    for g in gone:
        kept = F.when(~g, kept)
    return finite((finite(kept) * F.lit(float(scale_factor)) + F.lit(float(add_offset))) * F.lit(float(user_scale)))


def scale_fields(df: DataFrame, fields: list[str], scales: list[float]) -> DataFrame:
    return df.withColumns({f: F.col(f) * F.lit(float(s)) + F.lit(0.0) for f, s in zip(fields, scales, strict=True)})
