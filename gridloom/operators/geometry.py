"""Geometry of planes before a merge: registration, output extent, tile pruning, longitudes, units."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lattice import Axis, Lattice


def co_registered(a: Axis, b: Axis) -> bool:
    """Whether nodes of b fall on nodes of a: increments within 0.2 percent and no shift of phase."""
    if not (a.regular and b.regular) or abs(a.inc - b.inc) > 0.002 * abs(a.inc):
        return False
    shift = math.fmod(abs(b.lo - a.lo), abs(a.inc)) / abs(a.inc)
    return min(shift, 1 - shift) < 1e-8


def on_lattice(df: DataFrame, source: Lattice, target: Lattice) -> DataFrame:
    """A co-registered frame's indices moved to the target's; nodes outside of it go."""
    changes, inside = {}, F.lit(True)
    for a, t in zip(source.axes, target.axes, strict=True):
        if not co_registered(a, t):
            raise ValueError(f"axis {a.name} isn't co-registered; resample first")
        moved = F.col(a.key) + F.lit(round((a.lo - t.lo) / t.inc))
        changes[a.key] = moved.cast("int")
        inside = inside & moved.between(0, t.n - 1)
    return df.where(inside).withColumns(changes)


def union_lattice(lattices: list[Lattice]) -> Lattice:
    """The extent of all, with the increment that they share."""
    axes = []
    for k, first in enumerate(lattices[0].axes):
        every = [lat.axes[k] for lat in lattices]
        if any(abs(a.inc - first.inc) > 1e-8 * abs(first.inc) for a in every):
            raise ValueError(f"axis {first.name}: increments differ, so the output's has to be given")
        axes.append(Axis.sized(first.name, min(a.lo for a in every), max(a.hi for a in every), first.inc, first.unit))
    return Lattice(tuple(axes))


def overlapping(tiles: dict[str, Lattice], region: Lattice, turn: dict[str, float] | None = None) -> list[str]:
    """Names of the tiles that meet the region, in order; turn: the period of axes that go round, as 360 for longitudes."""
    turn = turn or {}

    def meets(a: Axis, b: Axis) -> bool:
        shifts = [0.0] if a.name not in turn else [k * turn[a.name] for k in (-2, -1, 0, 1, 2)]
        return any(a.lo + s <= b.hi and a.hi + s >= b.lo for s in shifts)

    return [n for n, lat in tiles.items() if all(meets(a, b) for a, b in zip(lat.axes, region.axes, strict=True))]


def wrapped(index: Column, offset: int, period: int) -> Column:
    """A column index shifted by an offset on an axis that goes round after `period` nodes."""
    return F.pmod(index + F.lit(offset), F.lit(period)).cast("int")


def to_si(df: DataFrame, velocities: list[str], densities: list[str], velocity: float = 1.0, density: float = 1.0) -> DataFrame:
    """Model properties to m/s and kg/m3; divide by the same factors, as from_si does, on the way out."""
    return df.withColumns({f: F.col(f) * F.lit(float(velocity)) for f in velocities} | {f: F.col(f) * F.lit(float(density)) for f in densities})


def from_si(df: DataFrame, velocities: list[str], densities: list[str], velocity: float = 1.0, density: float = 1.0) -> DataFrame:
    return to_si(df, velocities, densities, 1 / velocity, 1 / density)
