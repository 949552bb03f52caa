"""Word hashing and n-gram arithmetic on numpy arrays, used inside Arrow maps."""

from __future__ import annotations

import numpy as np
import xxhash

MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to `most` words so that memory stays bounded."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def grams(a: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams of `a`, in order; empty if there are fewer than k values."""
    n = len(a) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x = a[:n].copy()
    for i in range(1, k):
        x *= MIX
        x ^= x >> np.uint64(29)
        x += a[i : n + i]
    x ^= x >> np.uint64(31)
    x *= MIX
    x ^= x >> np.uint64(32)
    return x
