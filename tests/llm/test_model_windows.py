"""Windows and symbols of the language model."""

import numpy as np

from mediaops.llm import gru, lm_scoring


def test_window_of_the_model_by_its_steps():
    """States by the rule of a single step; lanes tell where their targets stand."""
    rng = np.random.default_rng(3)
    counts = np.sort(rng.integers(1, 999, 42))[::-1].copy()
    classes = gru.Classes.by_mass(counts, 6, 2)
    p = gru.start_parameters(counts, classes, 4)
    symbols, fresh = rng.integers(0, 42, (9, 5)), rng.random((9, 5)) < 0.3
    h = rng.normal(0, 0.5, (5, 4)).astype(np.float32)
    states, before = gru.run_window(p, h, symbols, fresh)[:2]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for t in range(9):
        h = np.where(fresh[t][:, None], 0, h)
        assert np.allclose(before[t], h, atol=1e-6)
        a, u = p["inputs"][symbols[t]], h @ p["recurrent"]
        r, z = sigmoid(a[:, :4] + u[:, :4]), sigmoid(a[:, 4:8] + u[:, 4:8])
        c = np.tanh(a[:, 8:] + r * u[:, 8:])
        h = c + z * (h - c)
        assert np.allclose(states[t], h, atol=1e-5)
    offsets = np.array([0, 7, 7, 12, 30])
    inputs, targets, starts, which = gru.lanes_of(np.arange(100, 130), offsets, 2, 99)
    assert (targets[which >= 0] == 100 + which[which >= 0]).all() and sorted(which[which >= 0]) == list(range(30)) and (targets[which < 0] == -1).all()
    assert (inputs[starts] == 99).all() and starts.sum() == 3


def test_symbols_of_hashes():
    """Hashes that share their first 16 bits are told apart, and unknown ones are the tail."""
    rng = np.random.default_rng(4)
    head = np.unique(np.concatenate([rng.integers(0, 2**64, 300, np.uint64), rng.integers(0, 2**48, 300, np.uint64), [2**64 - 1]]).astype(np.uint64))
    rng.shuffle(head)
    vocabulary = lm_scoring.Vocabulary(head, np.ones(len(head), np.int64), head[:0], np.zeros(0, np.int64), 10**6, 10**5, 5)
    asked = np.concatenate([head, head + np.uint64(1)])
    place = {int(h): i for i, h in enumerate(head)}
    assert vocabulary.symbols(asked).tolist() == [place.get(int(h), len(head)) for h in asked]
