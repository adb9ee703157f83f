"""Taper weights. A taper of ratio r covers r * n of the n nodes of a support; t = (i + 1/2) / (r n) runs over it.

The cosine is the default; boxcar is 1 whatever the ratios. The other shapes are textbook forms on t from 0 to 1,
scaled to end at 1; all are Column expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi


def _cosines(*a: float) -> Callable[[Column], Column]:
    """A cosine-sum window over its rising half, scaled to 1 at its top: sum of (-1)^k a_k cos(pi k t)."""
    top = sum(a)

    def shape(t):
        return sum(((-1) ** k * c * F.cos(F.lit(PI * k) * t) for k, c in enumerate(a[1:], 1)), F.lit(a[0])) / top

    return shape


def _sinc(u: Column) -> Column:
    return F.when(u == 0, 1.0).otherwise(F.sin(F.lit(PI) * u) / (F.lit(PI) * F.when(u == 0, 1.0).otherwise(u)))


def _from(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """f of the distance u = 1 - t from the top."""
    return lambda t: f(1 - t)


def _rise(f: Callable[[float], float], g: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A step function g over -1..1, scaled to go from 0 to 1."""
    lo, hi = f(-1.0), f(1.0)
    return lambda t: (g(2 * t - 1) - lo) / (hi - lo)


def _power(n: int) -> Callable[[Column], Column]:
    return lambda t: F.pow(t, F.lit(float(n)))


def _erf(x: float) -> float:
    return math.erf(2 * x)


def _erf_column(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26 of 2x; its error is under 2e-7."""
    a = F.abs(2 * x)
    k = 1 / (1 + 0.3275911 * a)
    poly = k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429))))
    return F.signum(x) * (1 - poly * F.exp(-a * a))


def _bessel0(x: Column) -> Column:
    """I0 by its series; 12 terms do for arguments up to 6."""
    q, term, total = x * x / 4, F.lit(1.0), F.lit(1.0)
    for k in range(1, 16):
        term = term * q / (k * k)
        total = total + term
    return total


_KAISER_TOP = sum((2.5 * PI / 2) ** (2 * k) / math.factorial(k) ** 2 for k in range(16))

#: Shapes by name.
SHAPES: dict[str, Callable[[Column], Column]] = {
    "cosine": lambda t: (1 - F.cos(F.lit(PI) * t)) / 2,
    "trapezoid": lambda t: t,
    "hamming": _cosines(0.54, 0.46),
    "blackman": _cosines(0.42, 0.5, 0.08),
    "exactblackman": _cosines(7938 / 18608, 9240 / 18608, 1430 / 18608),
    "blackmanharris": _cosines(0.35875, 0.48829, 0.14128, 0.01168),
    "blackmannuttall": _cosines(0.3635819, 0.4891775, 0.1365995, 0.0106411),
    "nuttall": _cosines(0.355768, 0.487396, 0.144232, 0.012604),
    "flattop": _cosines(0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368),
    "welch": _from(lambda u: 1 - u * u),
    "riesz": _from(lambda u: 1 - u * u),
    "parzen": _from(lambda u: F.when(u <= 0.5, 1 - 6 * u * u * (1 - u)).otherwise(2 * F.pow(1 - u, F.lit(3.0)))),
    "gaussian": _from(lambda u: F.exp(-0.5 * F.pow(u / 0.4, F.lit(2.0)))),
    "smoothstep": lambda t: t * t * (3 - 2 * t),
    "smootherstep": lambda t: t * t * t * (t * (6 * t - 15) + 10),
    "exponential": lambda t: (F.exp(3 * t) - 1) / (math.exp(3) - 1),
    "sine": lambda t: F.sin(F.lit(PI / 2) * t),
    "bohman": _from(lambda u: (1 - u) * F.cos(F.lit(PI) * u) + F.sin(F.lit(PI) * u) / PI),
    "kaiser": _from(lambda u: _bessel0(2.5 * PI * F.sqrt(F.greatest(1 - u * u, F.lit(0.0)))) / _KAISER_TOP),
    "kaiserbessel": _from(lambda u: _bessel0(2.5 * PI * F.sqrt(F.greatest(1 - u * u, F.lit(0.0)))) / _KAISER_TOP),
    "cauchy": _from(lambda u: 1 / (1 + F.pow(3 * u, F.lit(2.0)))),
    "quadratic": _power(2),
    "cubic": _power(3),
    "quartic": _power(4),
    "quintic": _power(5),
    "septic": _power(7),
    "nonic": _power(9),
    "root": lambda t: F.sqrt(t),
    "powerlaw": lambda t: F.pow(t, F.lit(1.5)),
    "bartlett": _from(lambda u: 1 - u),
    "bartletthann": _from(lambda u: 0.62 - 0.24 * u + 0.38 * F.cos(F.lit(PI) * u)),
    "lanczos": _from(_sinc),
    "riemann": _from(_sinc),
    "fejer": _from(lambda u: F.pow(_sinc(u), F.lit(2.0))),
    "hanningpoisson": _from(lambda u: 0.5 * (1 + F.cos(F.lit(PI) * u)) * F.exp(-2.0 * u)),
    "poisson": _from(lambda u: F.exp(-3.0 * u)),
    "plancktaper": lambda t: F.when(t <= 0, 0.0).when(t >= 1, 1.0).otherwise(1 / (1 + F.exp(1 / F.greatest(t, F.lit(1e-3)) - 1 / F.greatest(1 - t, F.lit(1e-3))))),
    "logistic": _rise(lambda x: 1 / (1 + math.exp(-5 * x)), lambda x: 1 / (1 + F.exp(-5 * x))),
    "tanh": _rise(lambda x: math.tanh(3 * x), lambda x: F.tanh(3 * x)),
    "erf": _rise(_erf, _erf_column),
    "arctan": _rise(lambda x: math.atan(5 * x), lambda x: F.atan(5 * x)),
    "gompertz": _rise(lambda x: math.exp(-math.exp(-4 * x)), lambda x: F.exp(-F.exp(-4 * x))),
    "softsign": _rise(lambda x: x / (0.2 + abs(x)), lambda x: x / (0.2 + F.abs(x))),
    "connes": _from(lambda u: F.pow(1 - u * u, F.lit(2.0))),
    "agnesi": _from(lambda u: 1 / (1 + 4 * u * u)),
    "inversequadratic": _from(lambda u: 1 / (1 + F.pow(2 * u, F.lit(2.0)))),
    "inversemultiquadric": _from(lambda u: 1 / F.sqrt(1 + F.pow(2 * u, F.lit(2.0)))),
    "circular": _from(lambda u: F.sqrt(F.greatest(1 - u * u, F.lit(0.0)))),
    "sech": _from(lambda u: 1 / F.cosh(3 * u)),
    "sech2": _from(lambda u: 1 / F.pow(F.cosh(2 * u), F.lit(2.0))),
    "student": _from(lambda u: F.pow(1 + u * u * 3, F.lit(-2.0))),
    "laplace": _from(lambda u: F.exp(-2.0 * u)),
}
ALIASES = {"hann": "cosine", "hanning": "cosine", "tukey": "cosine", "linear": "trapezoid", "barthann": "bartletthann"}
NAMES = ["boxcar", *SHAPES]


def canonical(name: str) -> str:
    name = ALIASES.get(name.lower(), name.lower())
    if name != "boxcar" and name not in SHAPES:
        raise ValueError(f"unknown window: {name}")
    return name


def ratios(text: str | None, dims: int) -> list[tuple[float, float]]:
    """(low, high) for each dimension from 1, dims or 2 dims numbers; 0.2 by default."""
    given = [float(r) for r in text.split("/")] if text else [0.2]
    if any(not 0 <= r < 0.5 for r in given):
        raise ValueError("taper ratios must be in [0, 0.5)")
    if len(given) == 1:
        return [(given[0], given[0])] * dims
    if len(given) == dims and dims > 1:
        return [(r, r) for r in given]
    if len(given) == 2 * dims:
        return [(given[2 * i], given[2 * i + 1]) for i in range(dims)]
    raise ValueError(f"1, {dims} or {2 * dims} taper ratios are needed")


def weight(i: Column, n: Column | int, low: Column | float, high: Column | float, name: str = "cosine") -> Column:
    """The weight of node i of a support of n nodes; i may lie between nodes, where end nodes go on as they are."""
    name = canonical(name)
    if name == "boxcar":
        return F.lit(1.0)
    n = F.lit(n) if isinstance(n, int) else n

    def side(at: Column, r) -> Column:
        r = F.lit(float(r)) if isinstance(r, (int, float)) else r
        t = (at + 0.5) / F.greatest(r * n, F.lit(1e-12))
        return F.when((r > 0) & (t < 1), F.least(F.greatest(SHAPES[name](t), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(1.0))

    return side(i, low) * side(n - 1 - i, high)


def weight_between(place: Column, n: Column | int, low, high, name: str = "cosine") -> Column:
    """The weight at a fractional place, linearly between the weights of the nodes beside it."""
    n_col = F.lit(n) if isinstance(n, int) else n
    k = F.least(F.greatest(F.floor(place + 1e-9), F.lit(0)), n_col - 1).cast("double")
    up = F.least(k + 1, n_col - 1)
    f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), place - k))
    return weight(k, n, low, high, name) * (1 - f) + weight(up, n, low, high, name) * f
