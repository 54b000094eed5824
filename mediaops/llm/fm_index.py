"""A bidirectional FM index over delimited words, searched for many patterns at once in numpy.

The text is ``$w1$w2$...$``.  Its Burrows-Wheeler transform and that of the reversed text are held as wavelet matrices.
A match is an interval in both suffix arrays, (low, mirrored low, size), and grows by a symbol on either side: the rank
of the symbol moves the interval of the side that grows, the number of smaller symbols moves the other one.
"""

from __future__ import annotations

import numpy as np

END, DELIMITER, LETTERS = 0, 1, 2  # codes: the end of the text, the delimiter, the first letter
NARROW = 16  # a wider interval asks for every letter, a narrower one lists those it holds


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of the suffixes in their order, by sorting prefixes of 8, 16, 32 ... symbols; codes are below 128."""
    n, step = len(text), 8
    padded = np.concatenate([text.astype(np.int64), np.zeros(step, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(step):
        key = key << 7 | padded[i : i + n]
    while True:
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: max(n - step, 0)] = rank[step:] + 1
        key = rank * (n + 1) + after
        step *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence, and how many smaller symbols a part of it has."""

    def __init__(self, values: np.ndarray):
        self.values = values
        symbols = int(values.max()) + 1
        self.bits = max(1, (symbols - 1).bit_length())
        self.zeros = []
        left = values
        for bit in reversed(range(self.bits)):
            ones = (left >> bit & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~ones)]))
            left = np.concatenate([left[~ones], left[ones]])
        before = np.concatenate([[0], np.cumsum(np.bincount(values, minlength=symbols))[:-1]])
        self.shift = np.zeros(symbols, np.int64)
        start, _, _ = self.part(np.arange(symbols), np.zeros(symbols, np.int64), np.zeros(symbols, np.int64))
        self.shift = before - start

    def part(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the rows of ``c`` in [low, high) stand in sorted order, as an interval, and how many are smaller."""
        less = np.zeros(len(c), np.int64)
        for level, zeros in enumerate(self.zeros):
            one = c >> (self.bits - 1 - level) & 1 == 1
            a, b = zeros[low], zeros[high]
            less += np.where(one, b - a, 0)
            low = np.where(one, zeros[-1] + low - a, a)
            high = np.where(one, zeros[-1] + high - b, b)
        return low + self.shift[c], high + self.shift[c], less


class BidirectionalIndex:
    """The index of distinct words, given as strings; ``codes`` maps their code points."""

    def __init__(self, words: list[str]):
        flat = np.frombuffer("\n".join(words).encode("utf-32-le"), np.uint32)  # no word holds a line feed
        self.alphabet = np.unique(flat[flat != 10])
        body = np.concatenate([[DELIMITER], self.codes(flat), [DELIMITER]])
        self.starts = np.flatnonzero(body == DELIMITER)
        forward, mirrored = (np.concatenate([x, [END]]) for x in (body, body[::-1]))
        self.order = suffix_array(forward)
        self.sides = tuple(WaveletMatrix(t[s - 1]) for t, s in ((forward, self.order), (mirrored, suffix_array(mirrored))))
        self.size = len(forward)

    def codes(self, points: np.ndarray) -> np.ndarray:
        """Codes of code points; the line feed is the delimiter, what no word has is -1."""
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        known = np.where(self.alphabet[at] == points, at + LETTERS, -1)
        return np.where(points == 10, DELIMITER, known).astype(np.int64)

    def extend(self, side: int, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """States (rows: low, mirrored low, size) with ``c`` put before the match (side 0) or behind it (side 1)."""
        here, there = state[side], state[1 - side]
        c = np.where(c < 0, END, c)  # an unknown letter: see below
        low, high, less = self.sides[side].part(c, here, here + state[2])
        size = np.where(c == END, 0, high - low)
        return np.stack([low, there + less, size] if side == 0 else [there + less, low, size])

    def letters(self, side: int, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the state, letter) for the letters that may stand beside each match."""
        size, narrow = state[2], state[2] <= NARROW
        who = np.repeat(np.flatnonzero(narrow), size[narrow])
        first = np.repeat(np.cumsum(size[narrow]) - size[narrow], size[narrow])
        beside = self.sides[side].values[state[side][who] + np.arange(len(who)) - first]
        listed = np.unique((who << 8 | beside)[beside >= LETTERS])
        wide, letters = np.flatnonzero(~narrow), np.arange(LETTERS, LETTERS + len(self.alphabet))
        return (
            np.concatenate([listed >> 8, np.repeat(wide, len(letters))]),
            np.concatenate([listed & 255, np.tile(letters, len(wide))]),
        )

    def words_of(self, state: np.ndarray) -> np.ndarray:
        """Numbers of the words whose delimited form a state matches."""
        return np.searchsorted(self.starts, self.order[state[0]])


def one_error(index: BidirectionalIndex, words: list[str], change: np.ndarray, from_left: bool) -> tuple[np.ndarray, np.ndarray]:
    """(pattern, word of the index) of the words that keep one half of a pattern and differ by one code point in the other.

    ``from_left``: the left half, rounded down, is matched exactly up to the delimiter, then the match grows to the
    right; otherwise the other way round.  ``change`` tells per pattern whether one code point of it is replaced (0),
    one is inserted (1) or one is left out (-1).  An insertion in a run of equal letters counts at the end of the run, a
    deletion too, so that each word is met once.
    """
    lengths = np.array([len(w) for w in words], np.int64)
    flat = index.codes(np.frombuffer("".join(words if from_left else [w[::-1] for w in words]).encode("utf-32-le"), np.uint32))
    starts = np.cumsum(lengths) - lengths
    half = lengths // 2 if from_left else lengths - lengths // 2
    out, back = (1, 0) if from_left else (0, 1)  # side of the other half, side of the exact half

    def symbol(q: np.ndarray, at: np.ndarray) -> np.ndarray:
        inside = (at >= 0) & (at < lengths[q])
        return np.where(inside, flat[np.minimum(starts[q] + np.maximum(at, 0), max(len(flat) - 1, 0))], DELIMITER)

    q = np.arange(len(words))
    state = np.stack([np.zeros_like(q), np.zeros_like(q), np.full_like(q, index.size)])
    at = half - 1
    done_q, done_state = [], []
    while len(q):
        state = index.extend(back, state, symbol(q, at))
        at = at - 1
        alive = state[2] > 0
        ended = alive & (at < -1)
        done_q.append(q[ended])
        done_state.append(state[:, ended])
        go = alive & ~ended
        q, state, at = q[go], state[:, go], at[go]
    q, state = np.concatenate([[], *done_q]).astype(np.int64), np.concatenate([np.zeros((3, 0), np.int64), *done_state], axis=1)
    at, used = half[q], np.zeros(len(q), bool)
    found_q, found_w = [], []
    while len(q):
        wanted = symbol(q, at)
        grown = [(q, index.extend(out, state, wanted), at + 1, used)]
        fresh = np.flatnonzero(~used)
        if len(fresh):
            skip = fresh[(change[q[fresh]] == -1) & (at[fresh] < lengths[q[fresh]]) & (symbol(q[fresh], at[fresh] + 1) != wanted[fresh])]
            grown.append((q[skip], state[:, skip], at[skip] + 1, np.ones(len(skip), bool)))
            more = fresh[(change[q[fresh]] == 1) | (change[q[fresh]] == 0) & (at[fresh] < lengths[q[fresh]])]
            who, letter = index.letters(out, state[:, more])
            other = letter != wanted[more[who]]
            who, letter = more[who[other]], letter[other]
            grown.append((q[who], index.extend(out, state[:, who], letter), at[who] + (change[q[who]] == 0), np.ones(len(who), bool)))
        q, at, used = (np.concatenate([g[i] for g in grown]) for i in (0, 2, 3))
        state = np.concatenate([g[1] for g in grown], axis=1)
        alive = state[2] > 0
        ended = alive & (at > lengths[q])
        hit = ended & used
        found_q.append(q[hit])
        found_w.append(index.words_of(state[:, hit]))
        go = alive & ~ended
        q, state, at, used = q[go], state[:, go], at[go], used[go]
    return np.concatenate([[], *found_q]).astype(np.int64), np.concatenate([[], *found_w]).astype(np.int64)
