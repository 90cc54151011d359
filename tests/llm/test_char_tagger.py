from __future__ import annotations

import itertools
import re

import numpy as np
import pytest
from quern.llm import char_tagger as ct


def some_model(kinds=2, hidden=4, seed=3):
    model = ct.start(kinds, hidden, seed)
    model.bias[:] = 0.3
    model.moves[0, 1:] = model.moves[1:, 0] = -0.7
    model.moves[range(1, kinds + 1), range(1, kinds + 1)] = 0.2
    return model


def ragged(length, n, seed=0):
    random = np.random.default_rng(seed)
    x = random.integers(1, ct.CLASSES, (length, n)).astype(np.uint8)
    sizes = random.integers(1, length + 1, n)
    sizes[0] = length
    x[np.arange(length)[:, None] >= sizes] = 0
    return x, sizes


def test_gradients_are_those_of_the_likelihood():
    model = some_model(3)
    x, sizes = ragged(9, 5)
    y = np.zeros((9, 5), dtype=np.int64)
    y[1:4, 0], y[5:7, 0], y[0:1, 1] = 2, 1, 3
    slopes, _ = ct.gradients(model, x, y)
    random = np.random.default_rng(1)
    for weights, slope in zip([*model.inputs, *model.states, model.out, model.bias, model.moves], slopes):
        for _ in range(8):
            at = tuple(random.integers(0, s) for s in weights.shape)
            if len(at) == 2 and weights.shape[0] == ct.CLASSES:
                at = (int(x[random.integers(0, 3), 0]), at[1])
            was = weights[at]
            if was < -1e3:
                continue
            weights[at] = was + 0.01
            above = ct.gradients(model, x, y)[1]
            weights[at] = was - 0.01
            below = ct.gradients(model, x, y)[1]
            weights[at] = was
            assert abs((above - below) / 0.02 - slope[at]) < 2e-3 + 0.01 * abs(slope[at])


def test_both_readers_agree():
    model = some_model()
    x, _ = ragged(30, 12)
    for back in (False, True):
        slow = ct._read(x, model.inputs[back], model.states[back], back)
        fast = ct._read_fast(x, model.inputs[back], model.states[back], back)
        assert np.abs(2 * slow - fast.transpose(0, 2, 1)).max() < 1e-5


def gain_of(path, e, moves):
    total = 0.0
    for t, tag in enumerate(path):
        total += (e[t, tag - 1] if tag else 0.0) + (moves[path[t - 1], tag] if t else 0.0)
    return total


def test_viterbi_and_its_shortcut_equal_all_paths():
    random = np.random.default_rng(5)
    moves = some_model().moves
    e = random.normal(-0.2, 0.8, (6, 60, 2)).astype(np.float32)
    sizes = random.integers(1, 7, 60)
    tags = ct.viterbi(e, sizes, moves)
    may = ct._have_spans(np.ascontiguousarray(e.transpose(0, 2, 1)), sizes, moves)
    empty = 0
    for j, size in enumerate(sizes):
        paths = [p for p in itertools.product(range(3), repeat=int(size)) if all(moves[a, b] > -1e3 for a, b in zip(p, p[1:]))]
        best = max(gain_of(p, e[:, j], moves) for p in paths)
        assert gain_of(tags[:size, j].tolist(), e[:, j], moves) == pytest.approx(best, abs=1e-5)
        assert not tags[size:, j].any()
        assert may[j] == (best > 1e-3) or abs(best) < 2e-3
        empty += not may[j]
    assert 0 < empty < 60


def taught():
    """Finds runs of digits."""
    random = np.random.default_rng(2)
    texts, spans = [], []
    for _ in range(240):
        text, own = "", []
        for _ in range(random.integers(1, 6)):
            if random.random() < 0.5:
                n = int(random.integers(1, 30))
                own.append((len(text), len(text) + n, 0))
                text += "7" * n
            text += " " + "ab c"[: random.integers(0, 5)] + " "
        texts.append(text)
        spans.append(own)
    return ct.train(texts, spans, 1, passes=6, batch=16, hidden=4)


def test_windows_cover_and_are_reconciled(monkeypatch):
    model = taught()
    random = np.random.default_rng(4)
    texts = ["", "777", "a", "7" * 500]
    for _ in range(40):
        texts.append("".join("7" * random.integers(3, 60) + " ab " * random.integers(1, 20) for _ in range(12)))
    wanted = [[(s, e, k) for s, e, k, _ in f] for f in ct.spans_of(model, texts)]
    runs = [[m.span() for m in re.finditer("7+", t)] for t in texts]
    assert [[w[:2] for w in f] for f in wanted] == runs
    monkeypatch.setattr(ct, "WINDOW", 64)
    monkeypatch.setattr(ct, "OVERLAP", 24)
    # Runs longer than an overlap, and one of many windows, are put together again.
    assert [[(s, e, k) for s, e, k, _ in f] for f in ct.spans_of(model, texts)] == wanted


def test_reconciled_takes_the_best_of_what_overlaps():
    found = [(0, 10, 0, 5.0, False), (8, 20, 1, 9.0, False), (18, 30, 0, 6.0, False), (40, 50, 1, 1.0, True), (45, 60, 1, 2.0, True)]
    assert ct.reconciled(found) == [(0, 10, 0, 5.0), (18, 30, 0, 6.0), (40, 60, 1, 2.0)]
    assert ct.reconciled([]) == []


def test_same_texts_give_same_weights_and_none_give_untrained():
    a, b = taught(), taught()
    assert np.array_equal(a.out, b.out) and np.array_equal(a.moves, b.moves)
    assert np.array_equal(ct.train([], [], 2).out, ct.start(2).out)
    assert ct.train(["", ""], [[], []], 2).kinds == 2
