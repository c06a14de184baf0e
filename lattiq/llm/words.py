"""Words of whole texts as numpy arrays, for operators that run on Arrow batches.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``: exactly what ``bytes.split()`` yields on UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Words kept per worker, about 20 MB; the cache holds results only.
_CACHE_WORDS = 100_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that scatters them (finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(sizes: list[int], limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of about ``limit`` bytes, so that a batch of long texts stays small."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words (``len(h) - k + 1`` values)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= MULT
        out += h[j : j + n]
    return mix(out)


class Spans:
    """Hashes of word spans of any length, from one pass of prefix sums (arithmetic mod 2**64)."""

    def __init__(self, h: np.ndarray):
        n = len(h)
        power = np.empty(n + 1, np.uint64)
        power[0] = 1
        power[1:] = MULT
        power = np.multiply.accumulate(power)
        inverse = np.empty(n + 1, np.uint64)
        inverse[0] = 1
        inverse[1:] = np.uint64(pow(int(MULT), -1, 1 << 64))
        self.inverse = np.multiply.accumulate(inverse)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(h) * power[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(x + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
