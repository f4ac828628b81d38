"""Hashed word shingles of whole texts, for the operators that run in Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
MULT = np.uint64(0x9E3779B97F4A7C15)
CACHE_WORDS = 400_000


def finish(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of a text's words: runs of bytes outside space and \\x09-\\x0D, A-Z lower-cased."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().translate(LOWER).split()
        known = self.known
        try:
            return np.array([known[w] for w in words], np.uint64)
        except KeyError:
            if len(known) > CACHE_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            return np.array([known[w] for w in words], np.uint64)


def shingle_set(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; one of the whole sequence when it is shorter; none without words."""
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    with np.errstate(over="ignore"):
        x = np.full(n - width + 1, width, np.uint64)
        for j in range(width):
            x = x * MULT + words[j : n - width + 1 + j]
        return np.unique(finish(x))
