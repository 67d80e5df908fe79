"""Hashes of many substrings at once, from prefix sums modulo 2**64."""

from __future__ import annotations

import numpy as np

U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Rolling:
    """Substring hashes: byte values from a seeded table, times powers of an odd base."""

    def __init__(self, seed: int):
        random = np.random.default_rng(seed)
        self.base = int(random.integers(1 << 62, 1 << 63)) * 2 + 1
        self.table = random.integers(0, 1 << 63, 256).astype(U) * U(2) + U(1)
        self.up = self.down = np.ones(1, U)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Sums that substrings() takes; data: bytes."""
        if len(self.up) <= len(data):
            size = max(len(data), 1 << 17)
            inverse = pow(self.base, -1, 1 << 64)
            self.up = np.cumprod(np.concatenate([np.ones(1, U), np.full(size, self.base, U)]), dtype=U)
            self.down = np.cumprod(np.concatenate([np.ones(1, U), np.full(size, inverse, U)]), dtype=U)
        return np.concatenate([np.zeros(1, U), np.cumsum(self.table[data] * self.up[: len(data)], dtype=U)])

    def substrings(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((prefix[ends] - prefix[starts]) * self.down[starts])
