"""Runs of chosen characters in whole texts, as positions in the UTF-8 bytes of an Arrow batch."""

from __future__ import annotations

import numpy as np

from mediaops.llm.words import Words

_TERM = np.ones(256, bool)  # letters and digits of ASCII, and every byte of any other character
_TERM[:0x30] = _TERM[0x3A:0x41] = _TERM[0x5B:0x61] = _TERM[0x7B:0x80] = False
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def find_runs(data: np.ndarray, inside: np.ndarray, offsets: np.ndarray) -> Words:
    """Maximal runs of bytes that are ``inside``; a text ends a run."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin, end = inside.copy(), inside.copy()
    if len(data):
        begin[1:] &= ~inside[:-1] | edge[1:-1]
        end[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begin)
    return Words(data, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets))


def term_bytes(data: np.ndarray) -> np.ndarray:
    """Bytes of letters, digits and of all characters beyond ASCII."""
    return _TERM[data]


def latin_letters(data: np.ndarray) -> np.ndarray:
    """Bytes of A-Z, a-z and U+00C0 to U+00FF, whose first byte in UTF-8 is 0xC3 and belongs to no other character."""
    inside = _ASCII_LETTER[data] | (data == 0xC3)
    inside[1:] |= data[:-1] == 0xC3
    return inside
