"""Polynomial hashes of byte ranges, for whole Arrow batches at once."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
#: A random 64-bit number for each byte, and two odd bases with their inverses modulo 2**64.
BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
BASES = [int(x) | 1 for x in _rng.integers(1 << 62, 1 << 63, 2, dtype=np.uint64)]
INVERSES = [pow(b, -1, 1 << 64) for b in BASES]
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        p = np.full(max(n, 1 << 20), base, np.uint64)
        p[0] = 1
        _powers[base] = np.multiply.accumulate(p)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of any ranges of some bytes: equal bytes have equal hashes, wherever they stand."""

    def __init__(self, data: np.ndarray, which: int = 0) -> None:
        n = len(data)
        self.inverse = INVERSES[which]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE[data] * powers(BASES[which], n), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        back = powers(self.inverse, len(self.sums))[start]
        return mix((self.sums[end] - self.sums[start]) * back + (end - start).astype(np.uint64))

    def every(self, width: int) -> np.ndarray:
        """Of each range of that width, from the first byte on."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * powers(self.inverse, n)) if n > 0 else np.zeros(0, np.uint64)
