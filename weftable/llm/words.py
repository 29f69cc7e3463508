"""Hashes of words and of runs of words, by NumPy, for operators on word windows and shingles."""

from __future__ import annotations

import numpy as np
import xxhash

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Words whose hash a worker remembers; longer words are hashed anew each time.
REMEMBERED, LONGEST = 120_000, 64


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = h
        return h


_known = _Words()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(_known.__getitem__, words), dtype=np.uint64, count=len(words))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k words, in order; order within a run matters."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        g = words[:n] * _A
        for j in range(1, k):
            g += words[j : n + j]
            g *= _A
        g ^= g >> np.uint64(31)
        g *= _B
        g ^= g >> np.uint64(29)
    return g
