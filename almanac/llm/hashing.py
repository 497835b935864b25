"""Hashes of words and word windows as arrays, for the operators that work on whole documents in tasks."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash

#: Words whose hash a Python worker remembers, and the longest of them in bytes.
CACHE_WORDS, CACHE_BYTES = 400_000, 64

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHE_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = value
        return value


_hashes = _WordHashes()


def texts_of(batch: pa.RecordBatch, column: int) -> list[bytes]:
    """UTF-8 texts; null counts as empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def word_hashes(words: Iterable[bytes], size: int) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, size)


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spreads 64-bit values evenly (a bijection)."""
    x = values + np.uint64(seed) * _FACTOR
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive values; empty where there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return hashes[:0]
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * _FACTOR + hashes[i:i + n]
    return mix(out)
