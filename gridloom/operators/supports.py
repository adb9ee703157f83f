"""Supports of merge records and random fields: intervals, boxes and polygons, and the weights on them."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import windows
from ..plans.lattice import EPS, Axis, Lattice


@dataclass(frozen=True)
class Taper:
    """Window and ratios of one dimension."""

    window: str = "cosine"
    low: float = 0.2
    high: float = 0.2


@dataclass(frozen=True)
class Support:
    """Index ranges by axis name, both ends within; with a polygon also the range of x in each row and of y in each column."""

    box: dict[str, tuple[int, int]]
    tapers: dict[str, Taper] = field(default_factory=dict)
    rows: dict[int, tuple[int, int]] | None = None
    cols: dict[int, tuple[int, int]] | None = None

    def weight(self) -> Column:
        """Null outside, else the product of the tapers. Polygon tapers run along the row and the column of the node."""
        inside, total = F.lit(True), F.lit(1.0)
        for name, (lo, hi) in self.box.items():
            i, t = F.col(f"i{name}"), self.tapers.get(name, Taper())
            inside = inside & i.between(lo, hi)
            if self.rows is not None and name in "xy":
                spans, at = (self.rows, F.col("iy")) if name == "x" else (self.cols, F.col("ix"))
                span = F.create_map(*[F.lit(v) for k, (a, b) in spans.items() for v in (k, a)]), F.create_map(*[F.lit(v) for k, (a, b) in spans.items() for v in (k, b)])
                a, b = F.try_element_at(span[0], at), F.try_element_at(span[1], at)
                inside = inside & F.coalesce(i.between(a, b), F.lit(False))
                n = b - a + 1
                # A short cross-section narrows both tapers alike; there the ratios are of its own length.
                total = total * windows.weight(i - a, n, t.low, t.high, t.window)
            else:
                total = total * windows.weight(i - lo, hi - lo + 1, t.low, t.high, t.window)
        return F.when(inside, total)


def interval_weight(x: Column, west: float, east: float, inc: float, taper: Taper = Taper(), domain: tuple[float, float] | None = None) -> Column:
    """The weight at coordinate x of a support from west to east, null outside."""
    if domain:
        near = 32 * EPS * max(1.0, abs(west), abs(east))
        if west < domain[0] - near or east > domain[1] + near:
            raise ValueError("a support must lie within the primary's domain")
    if east - west < inc * (1 - 1e-8):
        raise ValueError("a support must be one increment long at least")
    n = math.floor((east - west) / inc + 0.5) + 1
    place = (x - west) / (east - west) * (n - 1)
    return F.when(x.between(west, east), windows.weight_between(place, n, taper.low, taper.high, taper.window))


def index_range(lo: float, hi: float, axis: Axis) -> tuple[int, int]:
    return math.floor((lo - axis.lo) / axis.inc + 1e-8), math.ceil((hi - axis.lo) / axis.inc - 1e-8)


def box_support(lattice: Lattice, ranges: dict[str, tuple[float, float]], tapers: dict[str, Taper] | None = None) -> Support:
    return Support({a.name: index_range(*ranges.get(a.name, (a.lo, a.hi)), a) for a in lattice.axes}, tapers or {})


def plane_support(x: Axis, y: Axis, bounds: tuple[float, float, float, float], tapers: dict[str, Taper] | None = None, grown: bool = False) -> Support:
    """Bounds west, east, south, north; grown by a node on each side where a polygon made them, in planes."""
    add = 1 if grown else 0
    (x0, x1), (y0, y1) = index_range(bounds[0], bounds[1], x), index_range(bounds[2], bounds[3], y)
    return Support({"y": (y0 - add, y1 + add), "x": (x0 - add, x1 + add)}, tapers or {})


def polygon_spans(points: list[tuple[float, float]], x: Axis, y: Axis) -> tuple[dict[int, tuple[int, int]], dict[int, tuple[int, int]]]:
    """For each row of nodes that a polygon (in coordinates) meets, the first and last node; and for each column."""
    nodes = [(round((px - x.lo) / x.inc), round((py - y.lo) / y.inc)) for px, py in points]
    if len(set(nodes)) < 3:
        raise ValueError("a polygon needs three different nodes")
    return _spans(nodes, 1), _spans(nodes, 0)


def _spans(nodes: list[tuple[int, int]], along: int) -> dict[int, tuple[int, int]]:
    out: dict[int, tuple[int, int]] = {}
    closed = nodes if nodes[0] == nodes[-1] else [*nodes, nodes[0]]
    lo, hi = min(n[along] for n in nodes), max(n[along] for n in nodes)
    for r in range(lo, hi + 1):
        met = []
        for a, b in zip(closed, closed[1:], strict=False):
            p, q = sorted((a, b), key=lambda n: n[along])
            if p[along] <= r <= q[along]:
                if p[along] == q[along]:
                    met += [p[1 - along], q[1 - along]]
                else:
                    met.append(p[1 - along] + (q[1 - along] - p[1 - along]) * (r - p[along]) / (q[along] - p[along]))
        out[r] = (math.ceil(min(met) - 1e-9), math.floor(max(met) + 1e-9))
    return out


def crossings(nodes: list[tuple[float, float]], at: float, along: int) -> int:
    """How often a polygon crosses a line; more than twice means that it isn't monotone."""
    closed = nodes if nodes[0] == nodes[-1] else [*nodes, nodes[0]]
    return sum((a[along] < at) != (b[along] < at) for a, b in zip(closed, closed[1:], strict=False))


def is_monotone(points: list[tuple[float, float]]) -> bool:
    for along in (0, 1):
        levels = sorted({p[along] for p in points})
        if any(crossings(points, (a + b) / 2, along) > 2 for a, b in zip(levels, levels[1:], strict=False)):
            return False
    return True


def envelope(points: list[tuple[float, float]], x: Axis, y: Axis) -> list[tuple[float, float]]:
    """A monotone polygon of nodes around one that isn't: rows and columns are filled between their ends until none has a gap."""
    rows, _ = polygon_spans(points, x, y)
    while True:
        cols: dict[int, tuple[int, int]] = {}
        for r, (a, b) in rows.items():
            for c in range(a, b + 1):
                lo, hi = cols.get(c, (r, r))
                cols[c] = (min(lo, r), max(hi, r))
        more: dict[int, tuple[int, int]] = {}
        for c, (lo, hi) in cols.items():
            for r in range(lo, hi + 1):
                a, b = more.get(r, (c, c))
                more[r] = (min(a, c), max(b, c))
        if more == rows:
            break
        rows = more
    keys = sorted(rows)
    right = [(x.lo + rows[k][1] * x.inc, y.lo + k * y.inc) for k in keys]
    left = [(x.lo + rows[k][0] * x.inc, y.lo + k * y.inc) for k in reversed(keys)]
    return right + left


def piecewise_envelope(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """A monotone polygon from vertices of one that isn't.

    Between its extremes (west, north, east, south) a polygon has four sides. On each, a vertex that goes back in x or y is
    left out, so pieces of the outline stay as they are where they are monotone. Our own definition.
    """
    ring = points[:-1] if points[0] == points[-1] else list(points)
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]], strict=True))
    ring = ring[::-1] if area > 0 else ring  # clockwise
    n = len(ring)
    corners = [min(range(n), key=lambda i: ring[i]), max(range(n), key=lambda i: (ring[i][1], ring[i][0])), max(range(n), key=lambda i: ring[i]), min(range(n), key=lambda i: (ring[i][1], ring[i][0]))]
    out: list[tuple[float, float]] = []
    for k, (sx, sy) in enumerate(((1, 1), (1, -1), (-1, -1), (-1, 1))):
        first, last = corners[k], corners[(k + 1) % 4]
        end = ring[last]
        side = [ring[(first + i) % n] for i in range((last - first) % n)]
        for p in side:
            back = lambda a, b: sx * (b[0] - a[0]) < 0 or sy * (b[1] - a[1]) < 0  # noqa: B023, E731
            if not (out and side[0] != p and back(out[-1], p)) and not back(p, end):
                out.append(p)
    return out


def polygon_support(points: list[tuple[float, float]], x: Axis, y: Axis, tapers: dict[str, Taper] | None = None, convert: str | None = None) -> Support:
    """convert: "envelope" or "piecewise" makes a polygon monotone that isn't; else that is an error."""
    if not is_monotone(points):
        if convert not in ("envelope", "piecewise"):
            raise ValueError("the polygon is not monotone in x and y; convert it to its envelope")
        points = envelope(points, x, y) if convert == "envelope" else piecewise_envelope(points)
    rows, cols = polygon_spans(points, x, y)
    box = {"y": (min(rows), max(rows)), "x": (min(cols), max(cols))}
    return Support(box, tapers or {}, rows, cols)


def perturbation_support(lattice: Lattice, ranges: dict[str, tuple[float, float]] | None = None, polygon: list[tuple[float, float]] | None = None, tapers: dict[str, Taper] | None = None, convert: str | None = None) -> Support:
    """The support of a random field: ranges by axis name, and a polygon to which x and y shrink. It must lie within the lattice."""
    found = box_support(lattice, ranges or {}, tapers)
    if polygon:
        shape = polygon_support(polygon, lattice.axis("x"), lattice.axis("y"), tapers, convert)
        found = Support(found.box | shape.box, found.tapers, shape.rows, shape.cols)
    for a in lattice.axes:
        lo, hi = found.box[a.name]
        if lo < 0 or hi > a.n - 1:
            raise ValueError(f"axis {a.name}: the support must lie within the lattice")
    return found
