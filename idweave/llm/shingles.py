"""Hashes of words and of runs of words, in numpy."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
BLOCK = 1 << 20
_dealt = np.random.Generator(np.random.PCG64(20240607))
BYTE = _dealt.integers(1, 1 << 63, 256, dtype=np.uint64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
_powers = np.ones(0, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, BLOCK), BASE, np.uint64)]))
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each lower-case word; words lie between ASCII white space."""
    data = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64)
    space = np.concatenate([[True], IS_SPACE[data], [True]])
    start, end = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    power = powers(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[data] * power[: len(data)], dtype=np.uint64)])
    # sums are scaled to the same power at the far end, so equal words have equal hashes anywhere
    return mixed((total[end] - total[start]) * inverse_powers(len(data))[start])


_inverse = np.ones(0, np.uint64)


def inverse_powers(n: int) -> np.ndarray:
    global _inverse
    if len(_inverse) < n:
        _inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, BLOCK), pow(BASE, -1, 1 << 64), np.uint64)]))
    return _inverse


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted different hashes of the runs of ``words`` words; all words are one run where there are fewer, none give none."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = max(1, len(w) - words + 1)
    h = np.full(n, np.uint64(min(words, len(w))))
    for k in range(min(words, len(w))):
        h = mixed(h * np.uint64(BASE) + w[k : k + n])
    return np.unique(h)
