"""Filling of enclosed holes in planes. A hole is an 8-connected set of missing nodes that doesn't touch the edge.

Planes are independent, so a plane is a group and its work stays in one task; nodes that had values never change.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

METHODS = ("n", "l", "a", "s", "m")


def label_holes(z: np.ndarray, most: int | None = None) -> np.ndarray:
    """0 where there is a value or the hole isn't eligible, else the number of the hole. most: largest span of nodes in x and in y."""
    missing = ~np.isfinite(z)
    number = np.cumsum(missing.ravel()).reshape(z.shape) - 1
    i, j = np.nonzero(missing)
    if not len(i):
        return np.zeros(z.shape, np.int64)
    ends = []
    for di, dj in ((0, 1), (1, 0), (1, 1), (1, -1)):
        a, b = i + di, j + dj
        ok = (a < z.shape[0]) & (b >= 0) & (b < z.shape[1])
        ok[ok] = missing[a[ok], b[ok]]
        ends.append(np.stack([np.flatnonzero(ok), number[a[ok], b[ok]]]))
    root = _roots(len(i), *np.concatenate(ends, axis=1))
    first, of = np.unique(root, return_inverse=True)
    lo, hi = np.full((2, len(first)), max(z.shape)), np.full((2, len(first)), -1)
    for d, at in enumerate((i, j)):
        np.minimum.at(lo[d], of, at)
        np.maximum.at(hi[d], of, at)
    out = (lo.min(0) == 0) | (hi[0] == z.shape[0] - 1) | (hi[1] == z.shape[1] - 1)
    if most is not None:
        out |= (hi - lo + 1).max(0) > most
    label = np.zeros(z.shape, np.int64)
    label[i, j] = np.where(out, 0, np.arange(1, len(first) + 1))[of]
    return label


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each of 0 .. n-1 is connected with, by edges a, b."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return root
        a, b = a[open_], b[open_]
        np.minimum.at(root, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while not np.array_equal(up := root[root], root):
            root = up


def _grown(mask: np.ndarray) -> np.ndarray:
    """The nodes of a mask and their eight neighbours."""
    wide = np.pad(mask, 1)
    return np.any([wide[a : a + mask.shape[0], b : b + mask.shape[1]] for a in range(3) for b in range(3)], axis=0)


def fill_plane(z: np.ndarray, dy: float, dx: float, method: str = "l", arg: float | None = None, most: int | None = None, sectors: int = 4) -> np.ndarray:
    """n nearest (arg: radius), l linear, a local average (arg: radius), s spline, m minimum curvature (arg: tension).

    A hole is filled from the part of the plane around it that its method can reach.
    """
    label = label_holes(z, most)
    out = z.copy()
    holes = [k for k in np.unique(label) if k]
    if not holes:
        return out
    radius = (arg or 3.0) * max(dy, dx)
    ring = {"a": max(int(np.ceil(radius / min(dy, dx))), 1), "m": max(z.shape)}.get(method, 3)
    gi, gj = np.nonzero(label)
    order = np.argsort(label[gi, gj], kind="stable")
    gi, gj = gi[order], gj[order]
    ends = np.searchsorted(label[gi, gj], holes, "left").tolist() + [len(gi)]
    for k, at, to in zip(holes, ends, ends[1:], strict=False):
        i0, j0 = max(gi[at:to].min() - ring, 0), max(gj[at:to].min() - ring, 0)
        box = slice(i0, gi[at:to].max() + ring + 1), slice(j0, gj[at:to].max() + ring + 1)
        part, hole = z[box], label[box] == k
        hi, hj = np.nonzero(hole)
        if method == "s":
            got = _green(hi, hj, part, hole, dy, dx, arg or 0.0)
        elif method == "m":
            got = _relaxed(part, hole, dy, dx, arg or 0.0)[hi, hj]
        elif method == "l":
            got = _linear(hi, hj, part, hole, dy, dx)
        else:
            # The nearest value is always beside the hole: a straight way to any other one passes there.
            vi, vj = np.nonzero(np.isfinite(part) & (_grown(hole) if method == "n" else True))
            v, ay, ax = part[vi, vj], (hi * dy)[:, None] - vi * dy, (hj * dx)[:, None] - vj * dx
            d2 = ay**2 + ax**2
            if method == "n":
                near = d2.argmin(1)
                got = np.where(arg is None or np.sqrt(d2[np.arange(len(near)), near]) <= (arg or np.inf), v[near], np.nan)
            else:
                got = _local_average(d2, ay, ax, v, radius, sectors)
        ok = np.isfinite(got)
        out[hi[ok] + i0, hj[ok] + j0] = got[ok]
    return out


def _local_average(d2, ay, ax, v, radius, sectors):
    """The nearest value of each sector within the radius, weighted by 1 / (1 + 9 d2 / r2); half of the sectors must have one."""
    sector = (np.floor(np.arctan2(ay, ax) / (2 * np.pi) * sectors).astype(int)) % sectors
    total, value, n = np.zeros(len(d2)), np.zeros(len(d2)), np.zeros(len(d2), int)
    for s in range(sectors):
        d = np.where((sector == s) & (d2 <= radius * radius), d2, np.inf)
        at = d.argmin(1)
        best = d[np.arange(len(at)), at]
        has = np.isfinite(best)
        w = np.where(has, 1 / (1 + 9 * np.where(has, best, 0) / radius**2), 0)
        total, value, n = total + w, value + w * v[at], n + has
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n >= max(1, (sectors + 1) // 2), value / total, np.nan)


def _linear(hi, hj, z, hole, dy, dx):
    """Planes over the Delaunay triangles of the values around the hole (Bowyer-Watson)."""
    ri, rj = np.nonzero(_grown(hole) & np.isfinite(z))
    points = np.column_stack([ri * dy, rj * dx])
    values = z[ri, rj]
    out = np.full(len(hi), np.nan)
    for t in _triangles(points):
        a, b, c = points[t]
        m = np.array([b - a, c - a]).T
        if abs(np.linalg.det(m)) < 1e-12 * dy * dx:
            continue
        uv = np.linalg.solve(m, np.array([hi * dy - a[0], hj * dx - a[1]]))
        inside = (uv[0] >= -1e-9) & (uv[1] >= -1e-9) & (uv.sum(0) <= 1 + 1e-9) & np.isnan(out)
        va, vb, vc = values[t]
        out[inside] = va + uv[0][inside] * (vb - va) + uv[1][inside] * (vc - va)
    return out


def _triangles(points: np.ndarray) -> list[list[int]]:
    n = len(points)
    span = np.ptp(points, 0).max() or 1.0
    mid = points.mean(0)
    # A nudge far below a step settles which of four points on a circle make a triangle.
    p = points + np.column_stack([np.arange(n) * 1e-9 * span, (np.arange(n) ** 2 % 97) * 1e-9 * span])
    p = np.vstack([p, mid + [-20 * span, -20 * span], mid + [20 * span, -20 * span], mid + [0, 30 * span]])
    tris = [(n, n + 1, n + 2)]
    for i in range(n):
        bad = [t for t in tris if _in_circle(p, t, p[i])]
        edges: dict[tuple[int, int], int] = {}
        for t in bad:
            for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                key = (min(e), max(e))
                edges[key] = edges.get(key, 0) + 1
        gone = set(bad)
        tris = [t for t in tris if t not in gone] + [(a, b, i) for (a, b), c in edges.items() if c == 1]
    return [list(t) for t in tris if max(t) < n]


def _in_circle(p, t, q) -> bool:
    a, b, c = (p[k] - q for k in t)
    det = (a @ a) * (b[0] * c[1] - b[1] * c[0]) - (b @ b) * (a[0] * c[1] - a[1] * c[0]) + (c @ c) * (a[0] * b[1] - a[1] * b[0])
    x, y, z = (p[k] for k in t)
    turn = (y[0] - x[0]) * (z[1] - x[1]) - (y[1] - x[1]) * (z[0] - x[0])
    return det * np.sign(turn) > 0


def _green(hi, hj, z, hole, dy, dx, tension: float, ring: int = 3):
    """A spline in tension through the values at most `ring` nodes from the hole, as a sum of Green's functions.

    g(r) = r2 (ln r - 1) without tension, else K0(p r) + ln(p r) with p2 = T / (1 - T), in units of the mean increment. A
    plane is taken off before and put back after.
    """
    i0, i1, j0, j1 = max(hi.min() - ring, 0), min(hi.max() + ring + 1, z.shape[0]), max(hj.min() - ring, 0), min(hj.max() + ring + 1, z.shape[1])
    near = hole[i0:i1, j0:j1]
    for _ in range(ring):
        near = _grown(near)
    ri, rj = np.nonzero(near & np.isfinite(z[i0:i1, j0:j1]))
    unit = (dy + dx) / 2
    known, wanted = np.column_stack([(ri + i0) * dy, (rj + j0) * dx]) / unit, np.column_stack([hi * dy, hj * dx]) / unit
    values = z[ri + i0, rj + j0]
    plane = lambda p: np.column_stack([np.ones(len(p)), p])
    flat = np.linalg.lstsq(plane(known), values, rcond=None)[0]

    def green(a, b):
        r = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
        if tension:
            r = r * np.sqrt(tension / max(1 - tension, 1e-6))
            return np.where(r > 0, _bessel_k0(np.maximum(r, 1e-12)) + np.log(np.maximum(r, 1e-12)), np.log(2.0) - np.euler_gamma)
        return np.where(r > 0, r * r * (np.log(np.maximum(r, 1e-300)) - 1), 0.0)

    force = np.linalg.lstsq(green(known, known), values - plane(known) @ flat, rcond=1e-12)[0]
    return plane(wanted) @ flat + green(wanted, known) @ force


def _bessel_k0(x: np.ndarray) -> np.ndarray:
    """K0 by its integral, exp(-x cosh t) over t >= 0, with the trapezoidal rule, which converges fast here."""
    t = np.linspace(0, 36, 721)
    out = np.zeros_like(x)
    for k, at in enumerate(t):
        with np.errstate(over="ignore"):
            out += np.exp(-x * np.cosh(at)) * (0.5 if k == 0 else 1.0)
    return out * (t[1] - t[0])


def _relaxed(z, hole, dy, dx, tension: float):
    """Minimum curvature with tension inside the hole: (1 - T) biharmonic - T harmonic = 0, values around it held.

    Planes go on oddly beyond their edges. Other missing nodes near the hole count as the mean of the plane. The nodes of
    the hole are numbered along its shorter side, so their equations are a band, which is eliminated directly.
    """
    w = np.where(np.isfinite(z), z, np.nanmean(z))
    ij = np.argwhere(hole)
    if np.ptp(ij[:, 0]) < np.ptp(ij[:, 1]):
        ij = ij[np.lexsort((ij[:, 0], ij[:, 1]))]
    number = np.full(hole.shape, -1)
    number[ij[:, 0], ij[:, 1]] = np.arange(len(ij))
    parts = [(0, 0, 20 * (1 - tension) + 4 * tension)]
    parts += [(a, b, -8 * (1 - tension) - tension) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))]
    parts += [(a, b, 2 * (1 - tension)) for a, b in ((1, 1), (1, -1), (-1, 1), (-1, -1))]
    parts += [(a, b, 1 - tension) for a, b in ((2, 0), (-2, 0), (0, 2), (0, -2))]
    rows, cols, values, right = [], [], [], np.zeros(len(ij))

    def add(i, j, row, c):
        at = number[i, j]
        own = at >= 0
        rows.append(row[own])
        cols.append(at[own])
        values.append(c[own])
        np.subtract.at(right, row[~own], (c * w[i, j])[~own])

    for a, b, c in parts:
        row, i, j = np.arange(len(ij)), ij[:, 0] + a, ij[:, 1] + b
        # The value beyond an edge: twice that at the edge less that as far inside.
        ei, ej = np.clip(i, 0, z.shape[0] - 1), np.clip(j, 0, z.shape[1] - 1)
        out = (ei != i) | (ej != j)
        add(ei, ej, row, np.where(out, 2.0, 1.0) * c)
        add((2 * ei - i)[out], (2 * ej - j)[out], row[out], np.full(out.sum(), -float(c)))
    rows, cols, values = map(np.concatenate, (rows, cols, values))
    w[ij[:, 0], ij[:, 1]] = _banded(len(ij), rows, cols, values, right)
    return w


def _banded(n: int, rows, cols, values, right) -> np.ndarray:
    """The solution of a definite system, eliminated in blocks as wide as its band; raises if it does not hold."""
    wide = max(1, int(np.abs(rows - cols).max()))
    ends = np.append(np.arange(0, n, wide), n)
    ups, sums = [], []
    order = np.argsort(rows // wide, kind="stable")
    rows_, cols_, values_ = rows[order], cols[order], values[order]
    at = np.searchsorted(rows_ // wide, np.arange(len(ends)))
    for k, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False)):
        r, c, v = (x[at[k] : at[k + 1]] for x in (rows_, cols_, values_))
        block = np.zeros((hi - lo, 3 * wide))
        np.add.at(block, (r - lo, c - lo + wide), v)
        before, own, after = block[:, :wide], block[:, wide : wide + hi - lo], block[:, 2 * wide :]
        f = right[lo:hi]
        if k:
            own, f = own - before @ ups[-1][:, : hi - lo], f - before @ sums[-1]
        got = np.linalg.solve(own, np.column_stack([after, f]))
        ups.append(got[:, :-1])
        sums.append(got[:, -1])
    out = np.zeros(n)
    for k in range(len(sums) - 1, -1, -1):
        lo, hi = ends[k], ends[k + 1]
        nxt = out[hi : hi + wide]
        out[lo:hi] = sums[k] - ups[k][:, : len(nxt)] @ nxt
    left = right - np.bincount(rows, values * out[cols], n)
    if not np.abs(left).max() <= 1e-6 * max(1.0, np.abs(right).max(), np.abs(out).max()):
        raise ArithmeticError("the fill of a hole did not settle")
    return out


def _by_plane(df: DataFrame, layer: list[str], work, kinds: str) -> DataFrame:
    if layer:
        return df.groupBy(*layer).applyInPandas(work, kinds)
    from pyspark.sql import functions as F

    return df.withColumn("__all", F.lit(1)).groupBy("__all").applyInPandas(work, kinds)


def _plane(pdf: pd.DataFrame, f: str, ny: int, nx: int) -> np.ndarray:
    z = np.full((ny, nx), np.nan)
    z[pdf["iy"], pdf["ix"]] = pdf[f].to_numpy(float, na_value=np.nan)
    return z


def fill_holes(df: DataFrame, fields: list[str], ny: int, nx: int, dy: float = 1.0, dx: float = 1.0, layer: list[str] | None = None, method: str = "l", arg: float | None = None, most: int | None = None) -> DataFrame:
    """layer, iy, ix, fields at nodes with values after filling."""
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    if method in "sm" and not 0 <= (arg or 0) <= 1:
        raise ValueError("tension must be within 0 and 1")
    if method == "l" and arg is not None:
        raise ValueError("linear filling takes no argument")
    if method in "na" and arg is not None and arg < 0:
        raise ValueError("a radius must not be negative")
    layer = layer or []
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*layer).schema] if layer else []
    kinds += ["iy int", "ix int"] + [f"`{f}` double" for f in fields]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        iy, ix = np.meshgrid(np.arange(ny, dtype=np.int32), np.arange(nx, dtype=np.int32), indexing="ij")
        out = {c: pdf[c].iloc[0] for c in layer} | {"iy": iy.ravel(), "ix": ix.ravel()}
        out |= {f: fill_plane(_plane(pdf, f, ny, nx), dy, dx, method, arg, most).ravel() for f in fields}
        got = pd.DataFrame(out)
        return got[got[fields].notna().any(axis=1)].astype({f: object for f in fields}).where(lambda d: d.notna(), None)

    return _by_plane(df, layer, one, ", ".join(kinds))


def hole_labels(df: DataFrame, field: str, ny: int, nx: int, layer: list[str] | None = None, most: int | None = None) -> DataFrame:
    """layer, iy, ix, hole of the missing nodes that are eligible."""
    layer = layer or []
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*layer).schema] if layer else []

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        label = label_holes(_plane(pdf, field, ny, nx), most)
        i, j = np.nonzero(label)
        return pd.DataFrame({c: [pdf[c].iloc[0]] * len(i) for c in layer} | {"iy": i.astype(np.int32), "ix": j.astype(np.int32), "hole": label[i, j]})

    return _by_plane(df, layer, one, ", ".join([*kinds, "iy int", "ix int", "hole bigint"]))
