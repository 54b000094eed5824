"""Words of whole texts as positions in the UTF-8 bytes of an Arrow batch, and 64-bit hashes of words and word runs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BASES = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F))
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: np.uint64, n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of an odd base, or of its inverse, modulo 2**64."""
    key = (int(base), inverse)
    if key not in _POWERS or len(_POWERS[key]) < n:
        b = pow(int(base), -1, 1 << 64) if inverse else int(base)
        steps = np.full(max(n, 1 << 16), b, dtype=U64)
        steps[0] = 1
        table = np.cumprod(steps, dtype=U64)
        if n > 1 << 23:  # a very long text: not kept
            return table
        _POWERS[key] = table
    return _POWERS[key][:n]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = BASES[0]) -> np.ndarray:
    """Hashes of values[start:end], equal for equal runs wherever they stand."""
    total = np.zeros(len(values) + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * powers(base, len(values)), out=total[1:])
    inverse = powers(base, len(values) + 1, inverse=True)
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U64))


@dataclass
class Words:
    """Words of some texts: bytes, and per word its start and end; words of text t are first[t]:first[t + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, base: np.uint64 = BASES[0]) -> np.ndarray:
        return run_hashes(self.data, self.starts, self.ends, base)

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    inside = ~_WHITE[data]
    edge = np.zeros(len(data) + 1, bool)  # a text begins or ends here
    edge[offsets] = True
    begin, end = inside.copy(), inside.copy()
    if len(data):
        begin[1:] &= ~inside[:-1] | edge[1:-1]
        end[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begin)
    return Words(data, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets))


def single_spaced(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The words with exactly one blank between neighbours of a text, so that runs of words are runs of bytes."""
    inside = ~_WHITE[data]
    keep = inside.copy()
    if len(data):
        keep[1:] |= inside[:-1]  # the white space that follows a word
    if not keep.all():
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        data = data[keep]
    data = np.where(_WHITE[data], np.uint8(32), data)
    return find_words(data, offsets)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column without nulls."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def text_slices(batch: pa.RecordBatch, column: str = "text", size: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with about ``size`` bytes of text, with bytes and offsets; a longer text is alone."""
    at = batch.schema.get_field_index(column)
    if not batch.num_rows:
        return
    data, offsets = utf8(batch.column(at))
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[begin] + size, side="right")) - 1
        end = min(max(end, begin + 1), batch.num_rows)
        yield batch.slice(begin, end - begin), data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
        begin = end
