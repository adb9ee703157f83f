"""Axes and lattices: integer node indices, and coordinates worked out from them."""

from __future__ import annotations

import math
import sys
import warnings
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPS = sys.float_info.epsilon


@dataclass(frozen=True)
class Axis:
    """n nodes at lo, lo + inc, ... An irregular axis carries its coordinates."""

    name: str
    lo: float
    inc: float
    n: int
    unit: str | None = None
    coords: tuple[float, ...] | None = None

    @staticmethod
    def sized(name: str, lo: float, hi: float, inc: float, unit: str | None = None) -> Axis:
        """Nodes from lo to hi; hi moves to a node if it isn't one."""
        if not inc > 0 or not hi > lo:
            raise ValueError(f"axis {name}: needs lo < hi and a positive increment")
        n = math.floor((hi - lo) / inc + 0.5) + 1
        if n < 2:
            raise ValueError(f"axis {name}: fewer than two nodes")
        axis = Axis(name, lo, inc, n, unit)
        if abs(axis.hi - hi) > 32 * EPS * max(1.0, abs(hi)):
            warnings.warn(f"axis {name}: upper end moved from {hi} to {axis.hi}", stacklevel=2)
        return axis

    @staticmethod
    def of(name: str, coords, unit: str | None = None) -> Axis:
        """From given coordinates; regular if every step is within 256 eps of the mean step."""
        coords = tuple(map(float, coords))
        if len(coords) < 2:
            raise ValueError(f"axis {name}: fewer than two nodes")
        if not all(a < b for a, b in zip(coords, coords[1:], strict=False)) or not all(map(math.isfinite, coords)):
            raise ValueError(f"axis {name}: coordinates must be finite and strictly increasing")
        inc = (coords[-1] - coords[0]) / (len(coords) - 1)
        within = 256 * EPS * max(1.0, abs(coords[0]), abs(coords[-1]))
        regular = all(abs(b - a - inc) <= within for a, b in zip(coords, coords[1:], strict=False))
        return Axis(name, coords[0], inc, len(coords), unit, None if regular else coords)

    @property
    def hi(self) -> float:
        return self.coords[-1] if self.coords else self.lo + (self.n - 1) * self.inc

    @property
    def regular(self) -> bool:
        return self.coords is None

    @property
    def key(self) -> str:
        return f"i{self.name}"

    def values(self) -> list[float]:
        return list(self.coords) if self.coords else [self.lo + i * self.inc for i in range(self.n)]

    def coordinate(self, index: Column | None = None) -> Column:
        """The coordinate of a node index; never an accumulated sum."""
        index = F.col(self.key) if index is None else index
        if self.coords:
            return F.element_at(F.array(*map(F.lit, self.coords)), index.cast("int") + 1)
        return F.lit(float(self.lo)) + index * F.lit(float(self.inc))

    def scaled(self, factor: float, unit: str | None = None) -> Axis:
        """Coordinates times factor, samples in the same order. The unit goes where a factor comes without one."""
        if not math.isfinite(factor) or factor == 0:
            raise ValueError("a scale must be finite and not zero")
        coords = tuple(c * factor + 0.0 for c in self.coords) if self.coords else None
        return replace(self, lo=self.lo * factor + 0.0, inc=self.inc * factor, coords=coords, unit=unit or (self.unit if factor == 1 else None))

    def same(self, other: Axis) -> bool:
        within = 256 * EPS * max(1.0, abs(self.lo), abs(self.hi))
        return self.n == other.n and all(abs(a - b) <= within for a, b in zip(self.values(), other.values(), strict=True))


@dataclass(frozen=True)
class Lattice:
    """Axes from the slowest to the fastest: (x), (y, x) or (z, y, x)."""

    axes: tuple[Axis, ...]

    @property
    def keys(self) -> list[str]:
        return [a.key for a in self.axes]

    @property
    def size(self) -> int:
        return math.prod(a.n for a in self.axes)

    def axis(self, name: str) -> Axis:
        return next(a for a in self.axes if a.name == name)

    def nodes(self, spark: SparkSession, box: dict[str, tuple[int, int]] | None = None) -> DataFrame:
        """Node indices and coordinates, from one range; no cross join. box: first and last index by axis name, of the nodes wanted."""
        ends = {a.name: (box or {}).get(a.name, (0, a.n - 1)) for a in self.axes}
        df, left = spark.range(math.prod(max(hi - lo + 1, 0) for lo, hi in ends.values())), F.col("id")
        columns = {}
        for a in reversed(self.axes):
            lo, hi = ends[a.name]
            columns[a.key] = (left % max(hi - lo + 1, 1) + lo).cast("int")
            left = F.floor(left / max(hi - lo + 1, 1))
        df = df.select(*[columns[a.key].alias(a.key) for a in self.axes])
        return df.withColumns({a.name: a.coordinate() for a in self.axes})

    def covered(self, other: Lattice) -> dict[str, tuple[int, int]]:
        """First and last index by axis name of the nodes within the other's ends (the first after the last if there are none)."""
        found = {}
        for a, b in zip(self.axes, other.axes, strict=True):
            if a.regular:
                first, last = math.ceil((b.lo - a.lo) / a.inc - 1e-6), math.floor((b.hi - a.lo) / a.inc + 1e-6)
            else:
                within = [i for i, v in enumerate(a.values()) if b.lo <= v <= b.hi] or [0, -1]
                first, last = within[0], within[-1]
            found[a.name] = (max(first, 0), min(last, a.n - 1))
        return found

    def inside(self, other: Lattice) -> bool:
        """Whether this lattice lies within the other's ends, but for round-off."""
        near = lambda x: 64 * EPS * max(1.0, abs(x))
        return all(a.lo >= b.lo - near(b.lo) and a.hi <= b.hi + near(b.hi) for a, b in zip(self.axes, other.axes, strict=True))
