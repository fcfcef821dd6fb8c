"""Word shingles of whole texts as sets of 64-bit numbers."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, width: int = 5) -> np.ndarray:
    """Sorted distinct shingles of ``width`` words; A-Z lower-cased, words cut at ASCII blanks.

    With fewer words the whole sequence is the one shingle; without words there is none.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(width, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        total = total * FACTOR + codes[k : len(words) - size + 1 + k]
    return np.unique(mixed(total))
