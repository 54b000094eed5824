"""The perfect binary Golay code: 4096 codewords of 23 bits, every word within distance 3 of exactly one of them."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

BITS = 23
GENERATOR = 0b101011100011  # fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
KEYS = 6  # most codewords within distance 4 of a word


def _remainder(x: int) -> int:
    for shift in range(BITS - 1, 10, -1):
        if x >> shift & 1:
            x ^= GENERATOR << (shift - 11)
    return x


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits; per syndrome the error patterns to the codewords within distance 4."""
    low = np.array([_remainder(x) for x in range(1 << 12)], np.int64)
    high = np.array([_remainder(x << 12) for x in range(1 << 11)], np.int64)
    errors: list[list[int]] = [[] for _ in range(1 << 11)]
    single = [_remainder(1 << i) for i in range(BITS)]
    for weight in range(5):
        for places in combinations(range(BITS), weight):
            syndrome = 0
            for p in places:
                syndrome ^= single[p]
            if weight < 4 or len(errors[syndrome]) < KEYS:
                errors[syndrome].append(sum(1 << p for p in places))
    patterns = np.zeros((1 << 11, KEYS), np.int64)
    for s, found in enumerate(errors):
        patterns[s, : len(found)] = found
    return low, high, patterns, np.array([len(e) for e in errors], np.int64)


def nearby(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 bits) of the codewords within distance 4 of each 23-bit word, the nearest first, and their number.

    The nearest codeword of a word is among the nearby ones of every word that differs from it in one bit at most:
    it is within 3 of the one and so within 4 of the other.
    """
    low, high, patterns, counts = tables()
    words = words.astype(np.int64)
    syndrome = low[words & 0xFFF] ^ high[words >> 12]
    return (words[:, None] ^ patterns[syndrome]) >> 11, counts[syndrome]
