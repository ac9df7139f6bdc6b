"""Hashed words, word windows and MinHash signatures of whole texts, in numpy."""

from __future__ import annotations

import math

import numpy as np
import xxhash

#: Remembered words per worker at most.
WORDS = 1 << 19


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers by a fixed rule."""
    return np.array([xxhash.xxh3_64_intdigest(f"{seed}:{i}") | 1 for i in range(n)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the SplitMix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(h: np.ndarray, n: int, factors: np.ndarray) -> np.ndarray:
    """Hashes of all n consecutive words; empty if there are fewer."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1] * factors[0]
    for i in range(1, n):
        out += h[i : len(h) - n + 1 + i] * factors[i]
    return mix(out)


def bands_for(similarity: float, recall: float, most: int = 256) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest candidates, whose bands reach the recall at the
    similarity with no more than `most` hash functions."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - similarity)), 1)
    for rows in range(2, most):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


class MinHash:
    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        self.a, self.b = constants(bands * rows, 1), constants(bands * rows, 2)
        self.fold = constants(rows, 3)
        self.band = constants(bands, 4)

    def bands_of(self, s: np.ndarray) -> np.ndarray:
        """One hash per band of a set of 64-bit hashes (not empty)."""
        low = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(s), 1024):
            low = np.minimum(low, (np.multiply.outer(self.a, s[i : i + 1024]) + self.b[:, None]).min(1))
        return mix((low.reshape(self.bands, self.rows) * self.fold).sum(1, dtype=np.uint64) + self.band)
