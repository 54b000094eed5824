"""Token ids of whole texts with the tokenizers library, one look-up per blank-separated chunk."""

from __future__ import annotations

import os
import re

import numpy as np

from mediaops.llm.words import BASES, run_hashes

_INSIDE_RUN = re.compile(r"\s[ \n](?:\s|\Z)")
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_MAY_END_WHITE = _WHITE.copy()  # ASCII white space, or the last byte of a wider one
_MAY_END_WHITE[[0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F]] = True
_MAY_BEGIN_WHITE = _WHITE.copy()
_MAY_BEGIN_WHITE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_ENCODERS: dict[str, ChunkEncoder] = {}


class IdCache:
    """Ids of chunks by two 64-bit hashes, in flat arrays: a large sorted part and a small recent one."""

    def __init__(self, most: int):
        self.most = most
        self.parts = [self._empty(), self._empty()]

    @staticmethod
    def _empty() -> tuple[np.ndarray, ...]:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def find(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(part or -1, begin, length) per pair of hashes."""
        part = np.full(len(one), -1)
        begin, length = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
        for number, (first, second, at, size, _) in enumerate(self.parts):
            if len(first):
                place = np.minimum(np.searchsorted(first, one), len(first) - 1)
                hit = (first[place] == one) & (second[place] == two)
                part[hit], begin[hit], length[hit] = number, at[place[hit]], size[place[hit]]
        return part, begin, length

    def add(self, one: np.ndarray, two: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """New chunks; ``ids`` are theirs in a row."""
        begin = np.cumsum(size) - size
        self.parts[1] = self._merged(self.parts[1], (one, two, begin, size, ids))
        if len(self.parts[1][0]) > self.most // 8:
            self.parts = [self._merged(*self.parts), self._empty()]

    def trim(self) -> None:
        """Forget the large part when it is full; not while chunks that were found are still to be read."""
        if len(self.parts[0][0]) > self.most:
            self.parts[0] = self._empty()

    @staticmethod
    def _merged(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        first = np.concatenate([a[0], b[0]])
        order = np.argsort(first, kind="stable")
        at = np.concatenate([a[2], b[2] + len(a[4])])
        return first[order], np.concatenate([a[1], b[1]])[order], at[order], np.concatenate([a[3], b[3]])[order], np.concatenate([a[4], b[4]])


def gather(flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs flat[begin:begin + length] in a row."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(begin - ends + length, length) + np.arange(total)]


class ChunkEncoder:
    """Encodes texts, remembering the ids of chunks.

    The byte-level pre-tokenizer never joins what stands before a blank or line feed with that character and the word
    after it, unless the character lies inside or ends a longer run of white space.  So the ids of a text are the ids of its chunks
    ("word", " word", "\\nword", ...) in a row, and most chunks were seen before.  Texts where it does, with white space
    or the end after it, are encoded as a whole.  Strings of special tokens are ordinary text.
    """

    def __init__(self, path: str, most: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.cache = IdCache(most)
        self.line = self._ids("\n")
        self.marks = {ord(c): self._ids(c) for c in ",."}
        if len(self.line) != 1 or any(len(m) != 1 for m in self.marks.values()):
            raise ValueError("line feed, comma and full stop must be tokens")

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _encode(self, chunks: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Order in which chunks were done, number of ids of each and ids in a row.

        Chunks " word" go many at a time, with line feeds between them.
        """
        order, sizes, out = [], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        joined = [i for i, c in enumerate(chunks) if c[:1] == b" " and len(c) > 1 and b"\n" not in c and not _WHITE[c[1]]]
        alone = sorted(set(range(len(chunks))) - set(joined))
        for at in range(0, len(joined), 1000):
            part = joined[at : at + 1000]
            ids = self._ids(b"\n".join([chunks[i] for i in part]).decode())
            between = ids == self.line[0]
            if between.sum() != len(part) - 1:
                alone += part
                continue
            order += part
            sizes.append(np.diff(np.concatenate([[-1], np.flatnonzero(between), [len(ids)]])) - 1)
            out.append(ids[~between])
        for i, e in zip(alone, self.tokenizer.encode_batch_fast([chunks[i].decode() for i in alone], add_special_tokens=False)):
            order.append(i)
            out.append(np.array(e.ids, "<u4"))
            sizes.append(np.array([len(out[-1])], np.int64))
        return order, np.concatenate(sizes), np.concatenate(out)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        """Put new chunks into the cache, " word," by way of " word": letters and a mark after them are never one piece."""
        if not len(starts):
            return
        marked = np.isin(data[ends - 1], list(self.marks)) & (ends - starts > 2) & _LETTER[data[ends - 2]]
        stem_ends = ends[marked] - 1
        stem_one = run_hashes(data, starts[marked], stem_ends, BASES[0])
        stem_two = run_hashes(data, starts[marked], stem_ends, BASES[2])
        new_one, which = np.unique(np.concatenate([one[~marked], stem_one]), return_index=True)
        new_two = np.concatenate([two[~marked], stem_two])[which]
        begin = np.concatenate([starts[~marked], starts[marked]])[which]
        end = np.concatenate([ends[~marked], stem_ends])[which]
        fresh = np.flatnonzero(self.cache.find(new_one, new_two)[0] < 0)
        raw = data.tobytes()
        order, size, ids = self._encode([raw[a:b] for a, b in zip(begin[fresh].tolist(), end[fresh].tolist())])
        done = fresh[order]
        self.cache.add(new_one[done], new_two[done], size, ids)
        if marked.any():
            ids, size = self._found(stem_one, stem_two)
            last = np.array([self.marks[c][0] for c in data[ends[marked] - 1].tolist()], np.uint32)
            both = np.insert(ids, np.cumsum(size), last)
            self.cache.add(one[marked], two[marked], size + 1, both)

    def _found(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        part, begin, length = self.cache.find(one, two)
        if (part < 0).any():
            raise RuntimeError("a chunk is not in the cache")
        flats = [p[4] for p in self.cache.parts]
        return gather(np.concatenate(flats), begin + np.where(part == 1, len(flats[0]), 0), length), length

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets of texts in them) for UTF-8 bytes and their offsets."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        self.cache.trim()
        cut = (data == 32) | (data == 10)
        before_end = np.append(_MAY_BEGIN_WHITE[data[1:]], True)
        before_end[offsets[1:][offsets[1:] > 0] - 1] = True
        doubt = np.flatnonzero(cut[1:] & _MAY_END_WHITE[data[:-1]] & before_end[1:]) + 1
        whole = [t for t in np.unique(np.searchsorted(offsets, doubt, side="right") - 1) if self._odd(data, offsets, t)]
        for t in whole:
            cut[offsets[t] : offsets[t + 1]] = False
        cut[offsets[offsets < len(data)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        one, two = run_hashes(data, starts, ends, BASES[0]), run_hashes(data, starts, ends, BASES[2])
        distinct, first, inverse = np.unique(one, return_index=True, return_inverse=True)
        new = self.cache.find(distinct, two[first])[0] < 0
        at = first[new]
        self._learn(data, starts[at], ends[at], one[at], two[at])
        ids, length = self._found(distinct, two[first])
        begin = np.cumsum(length) - length
        sizes = length[inverse]
        texts = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, offsets)]
        return gather(ids, begin[inverse], sizes), texts

    @staticmethod
    def _odd(data: np.ndarray, offsets: np.ndarray, t: int) -> bool:
        return _INSIDE_RUN.search(data[offsets[t] : offsets[t + 1]].tobytes().decode()) is not None


def encoder(path: str) -> ChunkEncoder:
    """The encoder of this Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
