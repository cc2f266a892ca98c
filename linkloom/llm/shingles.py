"""Word shingle sets of texts as sorted 64-bit fingerprints."""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Sets of n-word shingles; A-Z count as a-z, words end at ASCII white space.
    A text of fewer words is one shingle, one without words has none."""

    def __init__(self, n: int, memo: int = 200_000):
        self.n, self.limit, self.memo = n, memo, {}

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        new = set(words).difference(self.memo)
        if len(self.memo) > self.limit:
            self.memo.clear()
            new = set(words)
        for w in new:
            self.memo[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(h))
        s = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            s = mix(s * _U(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
        return np.unique(s)
