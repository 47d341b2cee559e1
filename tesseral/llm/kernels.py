"""NumPy kernels over one text: word spans, word hashes and shingle hashes.

A word is a maximal run of bytes other than space and 0x09-0x0D of the UTF-8
text, with A-Z lower-cased.  All hashes are 64-bit and equal for equal words on
every machine; nothing here depends on Python's own seeded hash.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: a bijection on 64-bit words."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))
_SHINGLE_FACTORS = [int(v) | 1 for v in mix(np.arange(1001, 1065, dtype=U64))]
_powers = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i below n, grown on demand."""
    if len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            out = np.empty(size, dtype=U64)
            out[0] = 1
            done = 1
            step = base
            while done < size:
                take = min(done, size - done)
                out[done : done + take] = out[:take] * U64(step)
                done += take
                step = step * step & _MASK
            _powers[k] = out
    return _powers[0], _powers[1]


def lowered(text: str) -> np.ndarray:
    """The UTF-8 bytes of the text with A-Z lower-cased."""
    return _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which words start and end."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_IS_SPACE[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    up, down = _power_tables(len(data) + 1)
    running = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_BYTE_VALUE[data] * up[: len(data)], out=running[1:])
    value = (running[ends] - running[starts]) * down[starts]
    return mix(value + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def word_hashes(text: str | None) -> np.ndarray:
    """The hashes of the words of a text, in order; none for a null text."""
    if not text:
        return np.zeros(0, dtype=U64)
    data = lowered(text)
    return span_hashes(data, *word_spans(data))


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """The hashes of all runs of `size` words, in order and with repeats.

    A shorter non-empty sequence counts as one shingle of its own.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, dtype=U64)
    width = min(size, n)
    total = np.zeros(n - width + 1, dtype=U64)
    for k in range(width):
        total += words[k : n - width + 1 + k] * U64(_SHINGLE_FACTORS[k % 64])
    return mix(total + U64(width))


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(word_hashes(text), size))
