"""Interpolation kernels on numpy arrays."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def runs(x: np.ndarray, v: np.ndarray, bridge: bool | float) -> list[np.ndarray]:
    """Indices of the samples of each run."""
    at = np.flatnonzero(np.isfinite(v))
    if not len(at):
        return []
    gap = np.diff(at) > 1
    if bridge is True:
        gap[:] = False
    elif bridge:
        gap &= np.diff(x[at]) > bridge
    return np.split(at, np.flatnonzero(gap) + 1)


def sample(x: np.ndarray, v: np.ndarray, to: np.ndarray, mode: str = "l", bridge: bool | float = False, smooth: float = 0.0) -> np.ndarray:
    """Values at `to`, which increases; NaN outside all runs."""
    out = np.full(len(to), np.nan)
    for at in runs(x, v, bridge):
        xs, vs = x[at], v[at]
        if len(at) == 1:
            out[np.abs(to - xs[0]) <= 32 * EPS * np.maximum(1.0, np.abs(to))] = vs[0]
            continue
        near = 32 * EPS * max(1.0, abs(xs[0]), abs(xs[-1]))
        here = (to >= xs[0] - near) & (to <= xs[-1] + near)
        out[here] = along(xs, vs, np.clip(to[here], xs[0], xs[-1]), mode, smooth)
    return out


def along(x: np.ndarray, v: np.ndarray, to: np.ndarray, mode: str, smooth: float = 0.0) -> np.ndarray:
    if mode == "l" or len(x) == 2 and mode in "acs":
        return np.interp(to, x, v)
    k = np.clip(np.searchsorted(x, to, "right") - 1, 0, len(x) - 1)
    if mode == "e":
        return v[k]
    k = np.minimum(k, len(x) - 2)
    if mode == "n":
        return np.where(to - x[k] <= x[k + 1] - to, v[k], v[k + 1])
    if mode == "a":
        return _hermite(x, v, akima_slopes(x, v), to, k)
    values, second = smoothing(x, v, smooth) if mode == "s" and smooth > 0 else (v, natural(x, v))
    h = np.diff(x)
    a, b = (x[k + 1] - to) / h[k], (to - x[k]) / h[k]
    return a * values[k] + b * values[k + 1] + ((a**3 - a) * second[k] + (b**3 - b) * second[k + 1]) * h[k] ** 2 / 6


def _hermite(x, v, slope, to, k):
    h = x[k + 1] - x[k]
    t = (to - x[k]) / h
    return (1 + 2 * t) * (1 - t) ** 2 * v[k] + t * (1 - t) ** 2 * h * slope[k] + t * t * (3 - 2 * t) * v[k + 1] + t * t * (t - 1) * h * slope[k + 1]


def akima_slopes(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Akima (1970): slopes weighted by the change of the slopes beyond; two more are made up at each end."""
    m = np.diff(v) / np.diff(x)
    if len(m) == 1:
        return np.repeat(m, 2)
    m = np.concatenate([[3 * m[0] - 2 * m[1], 2 * m[0] - m[1]], m, [2 * m[-1] - m[-2], 3 * m[-1] - 2 * m[-2]]])
    d = np.abs(np.diff(m))
    left, right = d[2:], d[:-2]
    total = left + right
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(total > 0, (left * m[1:-2] + right * m[2:-1]) / total, (m[1:-2] + m[2:-1]) / 2)


def natural(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Second derivatives of the natural cubic spline."""
    n, h = len(x), np.diff(x)
    second = np.zeros(n)
    if n > 2:
        second[1:-1] = _tridiagonal(h[:-1] / 6, (h[:-1] + h[1:]) / 3, h[1:] / 6, np.diff(np.diff(v) / h))
    return second


def _tridiagonal(low, mid, up, rhs):
    n = len(mid)
    c, d = np.zeros(n), np.zeros(n)
    c[0], d[0] = up[0] / mid[0], rhs[0] / mid[0]
    for i in range(1, n):
        w = mid[i] - low[i] * c[i - 1]
        c[i], d[i] = up[i] / w, (rhs[i] - low[i] * d[i - 1]) / w
    for i in range(n - 2, -1, -1):
        d[i] -= c[i] * d[i + 1]
    return d


def smoothing(x: np.ndarray, v: np.ndarray, p: float) -> tuple[np.ndarray, np.ndarray]:
    """Reinsch: values and second derivatives of the spline that minimises squared misfit plus p times squared curvature."""
    h = np.diff(x)
    m = len(x) - 2
    if m < 1:
        return v.astype(float), np.zeros(len(x))
    left, right = 1 / h[:-1], 1 / h[1:]
    mid = -left - right
    diagonal = (h[:-1] + h[1:]) / 3 + p * (left**2 + mid**2 + right**2)
    one = h[1:-1] / 6 + p * (mid[:-1] * left[1:] + right[:-1] * mid[1:])
    two = p * right[:-2] * left[2:]
    inner = _five_bands(diagonal, one, two, left * v[:-2] + mid * v[1:-1] + right * v[2:])
    out = v.astype(float).copy()
    out[:-2] -= p * left * inner
    out[1:-1] -= p * mid * inner
    out[2:] -= p * right * inner
    return out, np.concatenate([[0.0], inner, [0.0]])


def _five_bands(diagonal, one, two, right) -> np.ndarray:
    """The solution of a positive definite system with two bands on each side of its diagonal."""
    n = len(diagonal)
    d, l1, l2, y = np.zeros(n + 2), np.zeros(n + 2), np.zeros(n + 2), np.zeros(n + 2)
    one, two = np.append(one, [0.0, 0.0]), np.append(two, [0.0, 0.0, 0.0])
    for i in range(n):  # places -1 and -2 are the zeros at the end
        d[i] = diagonal[i] - d[i - 1] * l1[i - 1] ** 2 - d[i - 2] * l2[i - 2] ** 2
        l1[i] = (one[i] - d[i - 1] * l1[i - 1] * l2[i - 1]) / d[i]
        l2[i] = two[i] / d[i]
        y[i] = right[i] - l1[i - 1] * y[i - 1] - l2[i - 2] * y[i - 2]
    out = np.zeros(n + 2)
    for i in range(n - 1, -1, -1):
        out[i] = y[i] / d[i] - l1[i] * out[i + 1] - l2[i] * out[i + 2]
    return out[:n]


def _cubic_weights(t: np.ndarray) -> np.ndarray:
    """Cubic convolution (a = -0.5) weights of the four nodes around."""
    d = np.stack([1 + t, t, 1 - t, 2 - t])
    near, far = 1.5 * d**3 - 2.5 * d**2 + 1, -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2
    return np.where(d <= 1, near, far)


def bicubic(y: np.ndarray, x: np.ndarray, z: np.ndarray, to_y: np.ndarray, to_x: np.ndarray, threshold: float = 0.5) -> np.ndarray:
    """Cubic convolution on regular axes. Edges go on linearly; missing nodes count out, and half of the weight must have values."""
    wide = np.pad(z, 1)
    wide[0, 1:-1], wide[-1, 1:-1] = 2 * z[0] - z[1], 2 * z[-1] - z[-2]
    wide[:, 0], wide[:, -1] = 2 * wide[:, 1] - wide[:, 2], 2 * wide[:, -2] - wide[:, -3]
    weights = []
    for a, to in ((y, to_y), (x, to_x)):
        at = (to - a[0]) / ((a[-1] - a[0]) / (len(a) - 1))
        ok = (at >= -1e-9) & (at <= len(a) - 1 + 1e-9)
        k = np.clip(np.floor(at + 1e-9).astype(int), 0, len(a) - 2)
        weights.append((ok, k, _cubic_weights(np.clip(at - k, 0, 1))))
    (oky, ky, wy), (okx, kx, wx) = weights
    total, value = np.zeros((len(to_y), len(to_x))), np.zeros((len(to_y), len(to_x)))
    for i in range(4):
        for j in range(4):
            v = wide[np.ix_(ky + i, kx + j)]
            w = wy[i][:, None] * wx[j][None, :]
            has = np.isfinite(v)
            total += np.where(has, w, 0)
            value += np.where(has, w * np.where(has, v, 0), 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        out = np.where(total >= threshold, value / total, np.nan)
    out[~oky] = np.nan
    out[:, ~okx] = np.nan
    return out


def separable(y, x, z, to_y, to_x, mode: str = "c") -> np.ndarray:
    """Along x, then along y, for irregular axes."""
    rows = np.array([sample(x, r, to_x, mode) for r in z])
    return np.array([sample(y, c, to_y, mode) for c in rows.T]).T
