"""Hashes of words and of runs of five words, the same in every worker."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """word -> 64-bit hash, kept per task; starts anew when large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.array([self[w] for w in words], dtype=np.uint64)


def shingles(word_hashes: np.ndarray, k: int = WORDS) -> np.ndarray:
    """One hash per run of k words in text order; a shorter text is one run, an empty one has none."""
    n = len(word_hashes)
    if n == 0:
        return word_hashes
    k = min(k, n)
    out = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        out += word_hashes[i : n - k + 1 + i] * _C[i]
    return mix(out)
