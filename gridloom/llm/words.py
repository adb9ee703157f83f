"""Words of whole texts as bytes, and hashes of runs of them, a batch at a time.

Words are runs of digits, a-z and non-ASCII characters after A-Z went to lower case: [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+.
"""

from __future__ import annotations

import numpy as np

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: An odd base and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A word that no text has, between texts.
BREAK = b"\x00"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class RunHashes:
    """Hashes of runs of words of many texts, put together with a break between them."""

    def __init__(self, texts: list[list[bytes]]):
        data = (b" " + BREAK + b" ").join(b" ".join(t) if t else BREAK for t in texts)
        raw = np.frombuffer(data, np.uint8)
        space = np.flatnonzero(raw == 32)
        self.starts = np.concatenate([[0], space + 1]).astype(np.int64)
        self.ends = np.concatenate([space, [len(raw)]]).astype(np.int64)
        up, self.down = _powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(raw.astype(np.uint64) * up[: len(raw)], out=self.sums[1:])
        n = np.array([max(len(t), 1) + 1 for t in texts], np.int64)
        #: Number of the first word of each text among all.
        self.first = np.concatenate([[0], np.cumsum(n)[:-1]])

    def of(self, k: int) -> np.ndarray:
        """The hash of the k words from each word on."""
        if len(self.starts) < k:
            return np.zeros(0, np.uint64)
        s, e = self.starts[: len(self.starts) - k + 1], self.ends[k - 1 :]
        h = (self.sums[e] - self.sums[s]) * self.down[s]
        h ^= h >> np.uint64(29)
        return h * np.uint64(0xBF58476D1CE4E5B9)


_cache: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _cache or len(_cache[0]) < n:
        size = max(n, 1 << 16)
        _cache[:] = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _cache.append(np.multiply.accumulate(p))
    return _cache[0], _cache[1]
