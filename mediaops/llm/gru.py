"""A gated recurrent language model in numpy: truncated backpropagation and an output softmax factored by classes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

F32 = np.float32
NAMES = ("inputs", "recurrent", "class_weights", "class_bias", "word_weights", "word_bias")


@dataclass
class Classes:
    """Output symbols in class order: symbols of class k are bounds[k]:bounds[k + 1]."""

    bounds: np.ndarray
    of: np.ndarray

    @staticmethod
    def by_mass(counts: np.ndarray, number: int, alone: int) -> Classes:
        """Contiguous classes of about equal mass for counts in falling order; the last ``alone`` symbols have their own."""
        plain = counts[: len(counts) - alone].astype(float)
        mass = np.cumsum(np.sqrt(plain)) / max(np.sqrt(plain).sum(), 1e-9)
        kind = np.minimum((mass * number).astype(int), number - 1) if len(plain) else np.zeros(0, int)
        kind = np.concatenate([np.unique(kind, return_inverse=True)[1], np.arange(alone) + len(np.unique(kind))]).astype(int)
        return Classes(np.searchsorted(kind, np.arange(kind.max() + 2)), kind)


def start_parameters(counts: np.ndarray, classes: Classes, hidden: int, seed: int = 1) -> dict[str, np.ndarray]:
    """Small random weights; the biases are logarithms of the counts, so the first model is the unigram model."""
    rng = np.random.default_rng(seed)
    n, k = len(counts), len(classes.bounds) - 1
    smooth = counts.astype(float) + 0.5
    mass = np.add.reduceat(smooth, classes.bounds[:-1])
    return {
        "inputs": rng.normal(0, 0.3, (n, 3 * hidden)).astype(F32),
        "recurrent": rng.normal(0, 0.3 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(F32),
        "class_weights": np.zeros((hidden, k), F32),
        "class_bias": np.log(mass / mass.sum()).astype(F32),
        "word_weights": np.zeros((n, hidden), F32),
        "word_bias": np.log(smooth / mass[classes.of]).astype(F32),
    }


def pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[n].ravel() for n in NAMES])


def unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for n in NAMES:
        out[n] = flat[at : at + like[n].size].reshape(like[n].shape).astype(F32)
        at += like[n].size
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= F32(0.5)
    np.tanh(x, out=x)
    x += F32(1)
    x *= F32(0.5)
    return x


def run_window(p: dict[str, np.ndarray], h: np.ndarray, symbols: np.ndarray, fresh: np.ndarray) -> tuple:
    """(states, before, gates, candidates, parts) of a window of steps x lanes: the states after each step, a list of those
    before, which are zero where ``fresh`` marks a step, both gates, the candidates and their recurrent parts.

    All rows are read at once, and each step works in place.
    """
    steps, lanes = symbols.shape
    n = h.shape[1]
    states, before, parts = np.empty((steps, lanes, n), F32), [], []
    gates, candidates = (np.ascontiguousarray(p["inputs"][:, part])[symbols] for part in (slice(2 * n), slice(2 * n, None)))
    begins = fresh.any(axis=1)
    for t in range(steps):
        gate, candidate, new = gates[t], candidates[t], states[t]
        if begins[t]:
            h = np.where(fresh[t][:, None], F32(0), h)
        before.append(h)
        u = h @ p["recurrent"]
        part = u[:, 2 * n :]
        parts.append(part)
        gate += u[:, : 2 * n]
        _sigmoid(gate)
        np.multiply(gate[:, :n], part, out=new)
        candidate += new
        np.tanh(candidate, out=candidate)
        np.subtract(h, candidate, out=new)
        new *= gate[:, n:]
        new += candidate
        h = new
    return states, before, gates, candidates, parts


def _exponentials(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp of x (in place) less its maximum, its sums per row, and per row the maximum plus the logarithm of the sum."""
    top = x.max(initial=-np.inf)
    low = x.max(axis=1) if len(x) and top - x.min() > 60 else None
    x -= top if low is None else low[:, None]
    np.exp(x, out=x)
    sums = x.sum(axis=1)
    return x, sums, np.log(sums) + (top if low is None else low)


def _target_logs(x: np.ndarray, targets: np.ndarray) -> np.ndarray:
    own = x[np.arange(len(targets)), targets]
    return own - _exponentials(x)[2]


def _loss_and_slope(x: np.ndarray, targets: np.ndarray) -> tuple[float, np.ndarray]:
    """Negative log-likelihood of the targets under the softmax of x, and its derivative by x."""
    rows = np.arange(len(targets))
    own = x[rows, targets]
    e, sums, logs = _exponentials(x)
    e /= sums[:, None]
    e[rows, targets] -= 1
    return float((logs - own).sum()), e


def _order(numbers: np.ndarray) -> np.ndarray:
    """Stable order of numbers from zero on, by digits if they are small."""
    return np.argsort(numbers.astype(np.uint16) if len(numbers) and numbers.max() < 1 << 16 else numbers, kind="stable")


def log_probabilities(p: dict[str, np.ndarray], classes: Classes, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural logarithm of each target's probability: its class, then the word inside the class."""
    kind = classes.of[targets]
    order = _order(kind)
    cuts = np.searchsorted(kind[order], np.arange(len(classes.bounds)))
    scores = states @ p["class_weights"]
    scores += p["class_bias"]
    out = _target_logs(scores, kind).astype(np.float64)
    sorted_states, sorted_targets = states[order], targets[order]
    inside = np.zeros(len(targets))
    for k in range(len(cuts) - 1):
        a, b = cuts[k], cuts[k + 1]
        low, high = classes.bounds[k], classes.bounds[k + 1]
        if a == b or high - low == 1:
            continue
        scores = sorted_states[a:b] @ p["word_weights"][low:high].T
        scores += p["word_bias"][low:high]
        inside[a:b] = _target_logs(scores, sorted_targets[a:b] - low)
    out[order] += inside
    return out


def gradients(
    p: dict[str, np.ndarray], classes: Classes, h: np.ndarray, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray
) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, float]:
    """Gradients of the loss over one window (steps x lanes), the state after it, and its loss per token.

    The gradient of the inputs has only the rows of the symbols read, which are returned too.

    ``fresh`` marks steps where a text begins: the state is zero before them.  Targets below zero are padding.  The
    gradient stops at the window's first step; the state does not.
    """
    steps, lanes = inputs.shape
    n = h.shape[1]
    g = {name: np.zeros_like(p[name]) for name in NAMES if name != "inputs"}
    run, before, gates, candidates, parts = run_window(p, h, inputs, fresh)
    all_states = run.reshape(-1, n)
    wanted = targets.ravel()
    use = np.flatnonzero(wanted >= 0)
    s, y = all_states[use], wanted[use]
    kind = classes.of[y]
    scores = s @ p["class_weights"]
    scores += p["class_bias"]
    loss, d = _loss_and_slope(scores, kind)
    g["class_weights"], g["class_bias"] = s.T @ d, d.sum(axis=0)
    ds = d @ p["class_weights"].T
    order = _order(kind)
    cuts = np.searchsorted(kind[order], np.arange(len(classes.bounds)))
    sorted_s, sorted_y, back = s[order], y[order], np.zeros_like(s)
    for k in range(len(cuts) - 1):
        a, b = cuts[k], cuts[k + 1]
        low, high = classes.bounds[k], classes.bounds[k + 1]
        if a == b or high - low == 1:
            continue
        scores = sorted_s[a:b] @ p["word_weights"][low:high].T
        scores += p["word_bias"][low:high]
        more, d = _loss_and_slope(scores, sorted_y[a:b] - low)
        loss += more
        g["word_weights"][low:high] = d.T @ sorted_s[a:b]
        g["word_bias"][low:high] = d.sum(axis=0)
        back[a:b] = d @ p["word_weights"][low:high]
    ds[order] += back
    d_all = np.zeros_like(all_states)
    d_all[use] = ds
    d_all = d_all.reshape(steps, lanes, n)
    d_inputs = np.empty((steps, lanes, 3 * n), F32)
    dh = np.zeros((lanes, n), F32)
    begins, back_weights = fresh.any(axis=1), p["recurrent"].T
    # Factors of all steps at once.
    not_candidates, not_gates, drift = 1 - candidates * candidates, 1 - gates, np.stack(before) - candidates
    for t in range(steps - 1, -1, -1):
        dh += d_all[t]
        r, z, not_r, not_z = gates[t, :, :n], gates[t, :, n:], not_gates[t, :, :n], not_gates[t, :, n:]
        old, da = before[t], d_inputs[t]
        dr, dz, dn = da[:, :n], da[:, n : 2 * n], da[:, 2 * n :]
        np.multiply(dh, not_z, out=dn)
        dn *= not_candidates[t]
        np.multiply(dh, drift[t], out=dz)
        dz *= z
        dz *= not_z
        np.multiply(dn, parts[t], out=dr)
        dr *= r
        dr *= not_r
        du = da.copy()
        du[:, 2 * n :] *= r
        g["recurrent"] += old.T @ du
        dh *= z
        dh += du @ back_weights
        if begins[t]:
            dh[fresh[t]] = 0
    flat, rows_of = d_inputs.reshape(-1, 3 * n), inputs.ravel()
    order = _order(rows_of)
    sorted_rows = rows_of[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))
    names = sorted_rows[first]
    g["inputs"] = np.add.reduceat(flat[order], first, axis=0)
    return g, names, run[-1], loss / max(1, len(use))


class Adagrad:
    def __init__(self, p: dict[str, np.ndarray], rate: float = 0.05):
        self.rate, self.sums = F32(rate), {n: np.full_like(p[n], 1e-4) for n in NAMES}

    def update(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray], read: np.ndarray, scale: float) -> None:
        for n in NAMES:
            rows = read if n == "inputs" else slice(None)
            d = g[n] * F32(scale)
            sums = self.sums[n][rows] + d * d
            self.sums[n][rows] = sums
            p[n][rows] -= self.rate * d / np.sqrt(sums)


def lanes_of(ids: np.ndarray, offsets: np.ndarray, lanes: int, start: int) -> tuple[np.ndarray, ...]:
    """(inputs, targets, fresh, which), steps x lanes: texts one after the other in lanes of about equal length.

    The input of a text's first step is ``start``; steps without a text have the target -1.  ``which`` tells the place
    of the target in ``ids``.
    """
    lengths = np.diff(offsets)
    lanes = max(1, min(lanes, len(lengths)))
    fill = np.zeros(lanes, np.int64)
    place = np.empty(len(lengths), np.int64)
    lane = np.empty(len(lengths), np.int64)
    # Longest first, dealt in rounds of alternating direction.
    for at, group in enumerate(np.array_split(np.argsort(-lengths, kind="stable"), max(1, -(-len(lengths) // lanes)))):
        to = np.argsort(fill, kind="stable")[: len(group)]
        lane[group], place[group] = to, fill[to]
        fill[to] += lengths[group]
    steps = int(fill.max()) if len(fill) else 0
    targets = np.full((steps, lanes), -1, np.int32)
    inputs = np.full((steps, lanes), start, np.int32)
    fresh = np.zeros((steps, lanes), bool)
    at = np.arange(len(ids))
    cell = (np.repeat(place - offsets[:-1], lengths) + at) * lanes + np.repeat(lane, lengths)
    targets.ravel()[cell] = ids
    which = np.full((steps, lanes), -1, np.int32)
    which.ravel()[cell] = at
    shifted = np.concatenate([[start], ids[:-1]]) if len(ids) else ids
    shifted[offsets[:-1][lengths > 0]] = start
    inputs.ravel()[cell] = shifted
    full = lengths > 0
    fresh[place[full], lane[full]] = True
    return inputs, targets, fresh, which


def pieces_of(offsets: np.ndarray, longest: int) -> np.ndarray:
    """Offsets with texts longer than ``longest`` cut into pieces."""
    cuts = [np.arange(a + longest, b, longest) for a, b in zip(offsets[:-1], offsets[1:]) if b - a > longest]
    return np.sort(np.concatenate([offsets, *cuts])) if cuts else offsets
