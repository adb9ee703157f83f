"""The random numbers of correlated fields: xorshift64* with a Box-Muller pair, and seeds of fields."""

from __future__ import annotations

import math

import numpy as np

MASK = (1 << 64) - 1
# The generator's multiplier, the seed that stands for 0, and the FNV hash offset and prime.
MULTIPLIER = 2685821657736338717
GOLDEN = 0x9E3779B97F4A7C15
FNV_OFFSET, FNV_PRIME = 1469598103934665603, 1099511628211


def _step(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(12)
    x = x ^ x << np.uint64(25)
    return x ^ x >> np.uint64(27)


def _times(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A matrix over bits, given by what it makes of each single bit, times states."""
    out = np.zeros_like(x)
    for bit in range(64):
        out ^= np.where(x >> np.uint64(bit) & np.uint64(1), matrix[bit], np.uint64(0))
    return out


def raw(seed: int, n: int) -> np.ndarray:
    """The first n numbers. A step is linear over bits, so the states at the starts of blocks are jumped to, and all blocks step together."""
    length = max(1, math.isqrt(n))
    jump, power, left = None, _step(np.uint64(1) << np.arange(64, dtype=np.uint64)), length
    while left:
        if left & 1:
            jump = power if jump is None else _times(power, jump)
        power, left = _times(power, power), left >> 1
    starts = np.array([seed & MASK or GOLDEN], np.uint64)
    while len(starts) * length < n:
        starts, jump = np.concatenate([starts, _times(jump, starts)]), _times(jump, jump)
    out = np.empty((length, len(starts)), np.uint64)
    for i in range(length):
        starts = _step(starts)
        out[i] = starts
    return out.T.ravel()[:n] * np.uint64(MULTIPLIER)


def gaussians(seed: int, n: int) -> np.ndarray:
    """Pairs of a cosine and a sine value, in that order."""
    u = ((raw(seed, n + n % 2) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
    r, angle = np.sqrt(-2 * np.log(u[0::2])), 2 * math.pi * u[1::2]
    return np.column_stack([r * np.cos(angle), r * np.sin(angle)]).ravel()[:n]


def fnv1a(text: str) -> int:
    h = FNV_OFFSET
    for b in text.encode():
        h = (h ^ b) * FNV_PRIME & MASK
    return h


def field_seed(seed: int, field: str, independent: bool) -> int:
    if not independent:
        return seed
    return (seed ^ (fnv1a(field) + GOLDEN + (seed << 6) + (seed >> 2))) & MASK
