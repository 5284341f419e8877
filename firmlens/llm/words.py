"""Hashes of words and shingles of many texts at once."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix32(x: np.ndarray, multiplier: int = 0x85EBCA6B, second: int = 0xC2B2AE35) -> np.ndarray:
    """A bijection of 32-bit values; odd multipliers give another one."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(multiplier)
    x ^= x >> np.uint32(13)
    x *= np.uint32(second)
    x ^= x >> np.uint32(16)
    return x


BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


class WordHashes:
    """64-bit hashes of the blank-separated words of a run of texts, ASCII letters in lower case.

    A word's hash is a polynomial of its bytes in a fixed odd base modulo 2**64, read off running sums, and mixed with
    its length.
    """

    def __init__(self):
        self._grow(1 << 20)

    def _grow(self, n: int) -> None:
        self.powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _BASE))])
        self.inverses = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _INVERSE))])

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of every word in order, number of words of each text)."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
        if n >= len(self.powers):
            self._grow(2 * n)
        inside = ~_BLANK[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cuts = offsets[:-1][np.diff(offsets) > 0]
        first[cuts] = inside[cuts]
        starts = np.flatnonzero(first)
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        ends = offsets[1:][np.diff(offsets) > 0] - 1
        last[ends] = inside[ends]
        stops = np.flatnonzero(last) + 1
        sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTE_VALUES[_LOWER[data]] * self.powers[:n])])
        hashes = mix64((sums[stops] - sums[starts]) * self.inverses[starts] + (stops - starts).astype(np.uint64))
        return hashes, np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])


def shingles(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of k words in order, number of runs of each text); a text of fewer words is one run of all its words."""
    runs = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    total = int(runs.sum())
    if not total:
        return np.zeros(0, np.uint64), runs
    ends = np.cumsum(counts)
    first = np.repeat(ends - counts - (np.cumsum(runs) - runs), runs) + np.arange(total)
    limit = np.repeat(ends, runs)
    out = np.zeros(total, np.uint64)
    for j in range(k):
        at = first + j
        known = at < limit
        term = np.zeros(total, np.uint64)
        term[known] = words[at[known]]
        out = mix64(out * _BASE + term + np.uint64(j + 1) * known)
    return out, runs


def distinct(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, and how many."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.bincount(owner[new], minlength=len(counts))
