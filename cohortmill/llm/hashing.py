"""Fingerprints of substrings of byte arrays, worked out for all places at once."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_DRAW = np.random.default_rng(4)
#: Values of the bytes and odd bases of two polynomial hashes; 3 modulo 8 keeps powers apart.
VALUES = _DRAW.integers(0, 2**64, (2, 256), dtype=U64)
BASES = (0x9E3779B97F4A7C13, 0xC2B2AE3D27D4EB53)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of a hash."""
    x = (x ^ (x >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


class Hashes:
    """Fingerprints of the substrings of a piece of bytes."""

    def __init__(self, data: np.ndarray, which: int):
        n, base = len(data), BASES[which]
        powers = np.full(n, base, U64)
        powers[:1] = 1
        np.cumprod(powers, out=powers)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(VALUES[which][data] * powers, out=self.sums[1:])
        inverse = np.full(n + 1, pow(base, -1, 1 << 64), U64)
        inverse[0] = 1
        self.inverse = np.cumprod(inverse)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])
