"""Random numbers and permutations that are functions of their place.

Each is computed from a seed and the number of a row, not from those drawn
before, so it is the same in whatever task the row is.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
ROUNDS = 8
#: Up to so many, all drawn numbers are ranked: a network has bias on few.
SMALL = 1 << 14


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that leaves no pattern (SplitMix64's finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word(*parts: int) -> np.uint64:
    """A 64-bit word of some integers."""
    out = np.array([0x9E3779B97F4A7C15], dtype=U64)
    for p in parts:
        out = mixed(out + np.array([p], dtype=U64) * U64(0xD1342543DE82EF95) + U64(1))
    return out[0]


def places(rows: np.ndarray, n: int, seed: int, number: int) -> np.ndarray:
    """Where the rows (of 0 .. n-1) go in a permutation of all n.  Of many, without
    the others: a Feistel network, walked on until it comes out below n."""
    if n <= SMALL:
        rank = np.empty(n, dtype=np.int64)
        rank[np.argsort(mixed(np.arange(n, dtype=U64) * U64(0x9E3779B97F4A7C15) + word(seed, number)), kind="stable")] = np.arange(n)
        return rank[rows]
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low, keys = U64((1 << half) - 1), [word(seed, number, k) for k in range(ROUNDS)]
    out = rows.astype(U64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> U64(half), out[todo] & low
        for key in keys:
            left, right = right, left ^ (mixed(right + key) & low)
        out[todo] = (left << U64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)
