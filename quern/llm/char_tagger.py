"""A character tagger: bidirectional LSTM with CRF transitions, in numpy.

Two LSTMs read a text from either end; from both states each character gets a score for
every kind of span, over the score of being in none. A conditional random field adds what it
costs to enter, stay in and leave a span (one kind never touches another), is trained by
forward-backward sums, and is decoded by Viterbi's algorithm.

Texts of any length are read in overlapping windows that together cover every character. The
spans that windows find are reconciled over the whole text: spans that a window's edge cuts
are joined with the same spans of the windows beside, and of spans that still overlap those
with the largest sum of scores stay.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

HIDDEN = 8

#: Characters of a window, and those that it shares with the next.
WINDOW = 1024
OVERLAP = 96
#: Windows that are read side by side.
SIDE_BY_SIDE = 1024

# Classes of characters: 0 pads; letters without case, digits as one, other ASCII one each.
_CLASS = np.zeros(129, dtype=np.uint8)
_CLASS[:33] = 2  # control characters and the blank
_CLASS[10] = _CLASS[13] = 3
_CLASS[128] = 1  # all beyond ASCII
_next = 4
for _c in range(33, 128):
    if chr(_c).isdigit():
        _CLASS[_c] = 4
    elif not chr(_c).isupper():
        _next += 1
        _CLASS[_c] = _next
for _c in range(ord("A"), ord("Z") + 1):
    _CLASS[_c] = _CLASS[_c + 32]
CLASSES = _next + 1


def classes(text: str) -> np.ndarray:
    """One class a character."""
    out = np.empty(len(text), dtype=np.uint8)
    for start in range(0, len(text), 1 << 20):
        codes = np.frombuffer(text[start : start + (1 << 20)].encode("utf-32-le"), dtype="<u4")
        out[start : start + len(codes)] = _CLASS[np.minimum(codes, 128)]
    return out


@dataclass
class Tagger:
    """Weights. ``moves[i, j]`` is from tag i to j; tag 0 is in no span."""

    inputs: tuple[np.ndarray, np.ndarray]  # one row a class, for either direction
    states: tuple[np.ndarray, np.ndarray]
    out: np.ndarray
    bias: np.ndarray
    moves: np.ndarray

    @property
    def kinds(self) -> int:
        return len(self.bias)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1.0
    return np.reciprocal(x, out=x)


def _read(x: np.ndarray, inputs: np.ndarray, states: np.ndarray, back: bool, keep: bool = False):
    """States ``(length, n, hidden)`` after each character; with ``keep`` also all gates and cells.

    Gates are input, forget, output and new content, the last as ``tanh(z) = 2 s(2 z) - 1``.
    """
    length, n = x.shape
    hidden = len(states)
    double = np.repeat(np.array([1, 1, 1, 2], dtype=np.float32), hidden)
    inputs, states = inputs * double, states * double
    out = np.zeros((length, n, hidden), dtype=np.float32)
    gates = np.empty((length if keep else 1, n, 4 * hidden), dtype=np.float32)
    cells = np.empty((length if keep else 1, n, hidden), dtype=np.float32)
    add, squashed = np.empty((n, 4 * hidden), dtype=np.float32), np.empty((n, hidden), dtype=np.float32)
    h, c = np.zeros((n, hidden), dtype=np.float32), np.zeros((n, hidden), dtype=np.float32)
    ragged = (x == 0).any(axis=1).tolist()
    for t in range(length - 1, -1, -1) if back else range(length):
        gate, cell = gates[t if keep else 0], cells[t if keep else 0]
        np.take(inputs, x[t], axis=0, out=gate, mode="clip")
        np.matmul(h, states, out=add)
        gate += add
        _sigmoid(gate)
        new = gate[:, 3 * hidden :]
        new *= 2.0
        new -= 1.0
        np.multiply(gate[:, hidden : 2 * hidden], c, out=squashed)
        np.multiply(gate[:, :hidden], new, out=cell)
        cell += squashed
        np.tanh(cell, out=squashed)
        h = np.multiply(gate[:, 2 * hidden : 3 * hidden], squashed, out=out[t])
        if ragged[t]:
            off = x[t] == 0
            h[off] = 0
            cell[off] = 0
        c = cell
    return (out, cells, gates) if keep else out


def _read_fast(x: np.ndarray, inputs: np.ndarray, states: np.ndarray, back: bool) -> np.ndarray:
    """Twice the states of :func:`_read`, as ``(length, hidden, n)``.

    All gates come from one hyperbolic tangent, as ``s(z) = (1 + tanh(z / 2)) / 2``, and each
    gate's rows lie together. Cells are held twice as large, too.
    """
    length, n = x.shape
    hidden = len(states)
    half = np.repeat(np.array([0.5, 0.5, 0.5, 1.0], dtype=np.float32), hidden)
    inputs, turned = inputs * half, np.ascontiguousarray((states * half).T) * np.float32(0.5)
    out = np.empty((length, hidden, n), dtype=np.float32)
    given, gate = np.empty((n, 4 * hidden), dtype=np.float32), np.empty((4 * hidden, n), dtype=np.float32)
    h, c, part = (np.zeros((hidden, n), dtype=np.float32) for _ in range(3))
    come, forget, tell = gate[:hidden], gate[hidden : 2 * hidden], gate[2 * hidden : 3 * hidden]
    new, sigmoids = gate[3 * hidden :], gate[: 3 * hidden]
    ragged = (x == 0).any(axis=1).tolist()
    for t in range(length - 1, -1, -1) if back else range(length):
        np.take(inputs, x[t], axis=0, out=given, mode="clip")
        np.matmul(turned, h, out=gate)
        gate += given.T
        np.tanh(gate, out=gate)
        sigmoids += 1.0
        c *= forget
        c *= 0.5
        new *= come
        c += new
        np.multiply(c, 0.5, out=part)
        np.tanh(part, out=part)
        h = np.multiply(tell, part, out=out[t])
        if ragged[t]:
            off = x[t] == 0
            h[:, off] = 0
            c[:, off] = 0
    return out


def emissions(model: Tagger, x: np.ndarray) -> np.ndarray:
    """``(length, kinds, n)``: the score of every kind over none, of each character."""
    hidden = len(model.states[0])
    weights = np.ascontiguousarray(model.out.T) * np.float32(0.5)
    ahead = _read_fast(x, model.inputs[0], model.states[0], back=False)
    e = np.matmul(weights[:, :hidden], ahead)
    del ahead
    e += np.matmul(weights[:, hidden:], _read_fast(x, model.inputs[1], model.states[1], back=True))
    e += model.bias[:, None]
    return e


def viterbi(e: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Tags ``(length, n)`` of the best path of each window; ``e`` is (length, n, kinds)."""
    length, n, kinds = e.shape
    leave, stay, enter = moves[1:, 0], np.diag(moves)[1:], moves[0, 1:]
    none, some = np.zeros(n, dtype=np.float32), e[0].copy()
    from_none = np.zeros((length, n, kinds), dtype=bool)
    from_some = np.zeros((length, n), dtype=np.int8)
    at_end = np.zeros((n, kinds + 1), dtype=np.float32)
    last = lengths - 1
    for t in range(length):
        if t:
            left = some + leave
            best = left.max(axis=1)
            from_some[t] = np.where(best > none, left.argmax(axis=1) + 1, 0)
            on, new = some + stay, none[:, None] + enter
            from_none[t] = new > on
            none, some = np.maximum(none, best), np.maximum(on, new) + e[t]
        done = last == t
        if done.any():
            at_end[done, 0], at_end[done, 1:] = none[done], some[done]
    tag = at_end.argmax(axis=1)
    tags = np.zeros((length, n), dtype=np.int8)
    row = np.arange(n)
    for t in range(length - 1, -1, -1):
        on = t <= last
        tags[t] = np.where(on, tag, 0)
        if t:
            before = np.where(
                tag == 0, from_some[t], np.where(from_none[t, row, np.maximum(tag, 1) - 1], 0, tag)
            )
            tag = np.where(on, before, tag)
    return tags


def _have_spans(e: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Whether each window's best path is in a span at all, told without finding the path.

    It is where some run of characters of one kind is worth more than entering and leaving
    it costs, which a window's first and last character do not pay.
    """
    leave, stay, enter = (m.astype(np.float32)[:, None] for m in (moves[1:, 0], np.diag(moves)[1:], moves[0, 1:]))
    length, kinds, n = e.shape
    last = sizes - 1
    ends = np.zeros((length, n), dtype=bool)
    ends[last, np.arange(n)] = True
    run, best = np.zeros((kinds, n), dtype=np.float32), np.full((kinds, n), -np.inf, dtype=np.float32)
    now = np.empty_like(run)
    at_end = ends.any(axis=1).tolist()
    for t in range(length):
        np.maximum(run, 0, out=run)
        run += np.add(e[t], stay, out=now)
        if t == 0:
            run -= enter
        if at_end[t]:
            run[:, ends[t]] -= leave
        np.maximum(best, run, out=best)
        if at_end[t]:
            run[:, ends[t]] = -np.inf  # pads follow, which no span is worth
    return (best > stay - enter - leave - 1e-3).any(axis=0)


def spans_of(model: Tagger, texts: Sequence[str]) -> list[list[tuple[int, int, int, float]]]:
    """``(start, end, kind, score)`` of every text's spans, in order; kinds from 0."""
    windows = []
    read = [classes(t) for t in texts]
    step = WINDOW - OVERLAP
    for i, x in enumerate(read):
        last = max(0, len(x) - OVERLAP)
        windows += [(min(WINDOW, len(x) - a), i, a) for a in range(0, max(last, 1), step) if len(x)]
    windows.sort(key=lambda w: -w[0])  # like lengths side by side
    found: list[list] = [[] for _ in texts]
    for first in range(0, len(windows), SIDE_BY_SIDE):
        group = windows[first : first + SIDE_BY_SIDE]
        x = np.zeros((group[0][0], len(group)), dtype=np.uint8)
        for j, (size, i, a) in enumerate(group):
            x[:size, j] = read[i][a : a + size]
        e = emissions(model, x)
        sizes = np.array([size for size, _, _ in group])
        worth = np.flatnonzero(_have_spans(e, sizes, model.moves))
        if not len(worth):
            continue
        sizes = sizes[worth]
        e = np.ascontiguousarray(e[:, :, worth].transpose(0, 2, 1))
        tags = viterbi(e, sizes, model.moves).T
        edge = np.zeros((len(worth), 1), dtype=np.int8)
        change = np.diff(tags, axis=1, prepend=edge, append=edge) != 0
        for j in np.flatnonzero(tags.any(axis=1)):
            size, i, a = group[worth[j]]
            at = np.flatnonzero(change[j])
            for s, t in zip(at, at[1:]):
                kind = int(tags[j, s]) - 1
                if kind < 0:
                    continue
                score = float(e[s:t, j, kind].sum()) + float(
                    model.moves[0, kind + 1] + model.moves[kind + 1, 0] + (t - s - 1) * model.moves[kind + 1, kind + 1]
                )
                cut = (s == 0 and a > 0) or (t == size and a + size < len(read[i]))
                found[i].append((a + int(s), a + int(t), kind, score, cut))
    return [reconciled(f) for f in found]


def reconciled(found: list[tuple[int, int, int, float, bool]]) -> list[tuple[int, int, int, float]]:
    """The spans of a text from those of its windows: ``(start, end, kind, score, cut)``.

    A span that its window's edge cuts is joined with those of its kind that it overlaps or
    touches. Then the spans that do not overlap and have the largest sum of scores stay.
    """
    joined: list[list] = []
    for start, end, kind, score, cut in sorted(found):
        near = next(
            (f for f in reversed(joined[-8:]) if f[2] == kind and start <= f[1] and (cut or f[4])), None
        )
        if near:
            near[1], near[3] = max(near[1], end), max(near[3], score)
            near[4] = near[4] or cut
        else:
            joined.append([start, end, kind, score, cut])
    spans = sorted({(s, e, k, max(v, 1e-6)) for s, e, k, v, _ in joined}, key=lambda f: (f[1], f[0], f[2]))
    # Weighted interval scheduling, by ends.
    ends = [f[1] for f in spans]
    best, take = [0.0], []
    for i, (start, _, _, score) in enumerate(spans):
        before = bisect_right(ends, start, hi=i)
        take.append(best[before] + score > best[i])
        best.append(max(best[i], best[before] + score))
    out, i = [], len(spans)
    while i:
        if take[i - 1]:
            out.append(spans[i - 1])
            i = bisect_right(ends, spans[i - 1][0], hi=i - 1)
        else:
            i -= 1
    return out[::-1]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a.T @ b`` in this thread: for matrices as narrow as these, more would only wait."""
    return np.einsum("ni,nj->ij", a, b)


def _unread(x, inputs, states, kept, slopes, back: bool):
    """Slopes of the inputs and states of one direction, given those of its states."""
    out, cells, gates = kept
    length, n, hidden = out.shape
    order = np.arange(length)[::-1] if back else np.arange(length)
    before_h, before_c = np.zeros_like(out), np.zeros_like(cells)
    before_h[order[1:]], before_c[order[1:]] = out[order[:-1]], cells[order[:-1]]
    gate = gates.reshape(length, n, 4, hidden)
    squashed = np.tanh(cells)
    # What the slope of the cell (of the state, for the output gate) is multiplied with.
    times = np.empty_like(gate)
    times[:, :, :3] = gate[:, :, :3] * (1 - gate[:, :, :3])
    times[:, :, 0] *= gate[:, :, 3]
    times[:, :, 1] *= before_c
    times[:, :, 2] *= squashed
    times[:, :, 3] = gate[:, :, 0] * (1 - gate[:, :, 3] ** 2)
    to_cell = gate[:, :, 2] * (1 - squashed**2)
    forget = np.ascontiguousarray(gate[:, :, 1])
    on = (x != 0)[:, :, None]
    for part in (times, to_cell[:, :, None], forget[:, :, None]):
        part *= on[:, :, :, None]
    turned = np.ascontiguousarray(states.T)
    dh, dc = np.zeros((n, hidden), dtype=np.float32), np.zeros((n, hidden), dtype=np.float32)
    for t in order[::-1].tolist():
        dh += slopes[t]
        dc += dh * to_cell[t]
        z = times[t]  # becomes the slope of what goes into the gates
        z[:, :2] *= dc[:, None]
        z[:, 2] *= dh
        z[:, 3] *= dc
        dh = z.reshape(n, -1) @ turned
        dc *= forget[t]
    rows = times.reshape(-1, 4 * hidden)
    d_states = _products(before_h.reshape(-1, hidden), rows)
    d_inputs = np.zeros_like(inputs)
    flat = x.ravel()
    by_class = np.argsort(flat, kind="stable")
    present, starts = np.unique(flat[by_class], return_index=True)
    d_inputs[present] = np.add.reduceat(rows[by_class], starts)
    d_inputs[0] = 0
    return d_inputs, d_states


def _field(e: np.ndarray, y: np.ndarray, on: np.ndarray, moves: np.ndarray):
    """Observed less expected tags (of the kinds) and moves, and the log-likelihood."""
    length, n, kinds = e.shape
    full = np.concatenate([np.zeros((length, n, 1)), e], axis=2)
    top = full.max(axis=2, keepdims=True)
    own = np.where(on[:, :, None], np.exp(full - top), 1.0)
    step, stand = np.exp(moves), np.eye(kinds + 1)
    ahead, scale = np.zeros_like(own), np.ones((length, n))
    for t in range(length):
        now = own[t] if t == 0 else np.where(on[t][:, None], (ahead[t - 1] @ step) * own[t], ahead[t - 1])
        scale[t] = now.sum(axis=1)
        ahead[t] = now / scale[t][:, None]
    behind = np.ones_like(own)
    expected = np.zeros_like(moves)
    for t in range(length - 1, 0, -1):
        after = own[t] * behind[t] / scale[t][:, None]
        expected += step * ((ahead[t - 1] * on[t][:, None]).T @ after)
        behind[t - 1] = np.where(on[t][:, None], after @ step.T, behind[t])
    share = ahead * behind
    share /= share.sum(axis=2, keepdims=True)
    seen = stand[y]
    slope = (seen - share)[:, :, 1:] * on[:, :, None]
    both = on[1:]
    observed = np.zeros_like(moves)
    np.add.at(observed, (y[:-1][both], y[1:][both]), 1.0)
    picked = np.take_along_axis(full, y[:, :, None], 2)[:, :, 0]
    told = (picked * on).sum() + moves[y[:-1][both], y[1:][both]].sum()
    norm = (np.log(scale) + np.where(on, top[:, :, 0], 0.0)).sum()
    return slope, observed - expected, float(told - norm)


def gradients(model: Tagger, x: np.ndarray, y: np.ndarray):
    """Slopes of the log-likelihood of tags ``y`` in all weights, and that likelihood."""
    hidden = len(model.states[0])
    kept = [_read(x, model.inputs[d], model.states[d], back=bool(d), keep=True) for d in (0, 1)]
    both = np.concatenate([kept[0][0], kept[1][0]], axis=2)
    e = (both @ model.out + model.bias).astype(np.float64)
    on = x != 0
    slope, d_moves, told = _field(e, y, on, model.moves)
    slope = slope.astype(np.float32)
    flat = slope.reshape(-1, model.kinds)
    d_out, d_bias = _products(both.reshape(-1, 2 * hidden), flat), flat.sum(axis=0)
    back = slope @ model.out.T
    parts = [
        _unread(x, model.inputs[d], model.states[d], kept[d], back[:, :, d * hidden : (d + 1) * hidden], bool(d))
        for d in (0, 1)
    ]
    return [parts[0][0], parts[1][0], parts[0][1], parts[1][1], d_out, d_bias, d_moves], told


def start(kinds: int, hidden: int = HIDDEN, seed: int = 7) -> Tagger:
    """Untrained weights."""
    random = np.random.default_rng(seed)

    def some(*shape: int, size: float) -> np.ndarray:
        return (random.standard_normal(shape) * size).astype(np.float32)

    inputs = []
    for _ in range(2):
        rows = some(CLASSES, 4 * hidden, size=0.5)
        rows[:, hidden : 2 * hidden] += 1.5  # remembers at first
        inputs.append(rows)
    states = [some(hidden, 4 * hidden, size=0.3) for _ in range(2)]
    moves = np.full((kinds + 1, kinds + 1), -1e4)
    moves[0, 0] = 0.0
    moves[0, 1:] = moves[1:, 0] = -2.0
    moves[range(1, kinds + 1), range(1, kinds + 1)] = 0.0
    return Tagger(
        tuple(inputs), tuple(states), some(2 * hidden, kinds, size=0.2), np.full(kinds, -1.0, np.float32), moves
    )


def train(
    texts: list[str],
    spans: list[list[tuple[int, int, int]]],
    kinds: int,
    passes: int = 3,
    batch: int = 32,
    rate: float = 0.05,
    hidden: int = HIDDEN,
    seed: int = 7,
) -> Tagger:
    """Weights fitted to texts with labelled spans ``(start, end, kind)``, by Adam.

    The same texts give the same weights. Kinds never touch; no text leaves untrained weights.
    """
    model = start(kinds, hidden, seed)
    random = np.random.default_rng(seed)
    free = model.moves > -1e3
    free[0, 0] = False
    weights = [*model.inputs, *model.states, model.out, model.bias, model.moves]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    texts_with = [i for i in range(len(texts)) if texts[i]]
    steps, step = passes * -(-len(texts_with) // batch), 0
    for _ in range(passes):
        # Batches of like lengths, in a random order.
        order = sorted(random.permutation(texts_with).tolist(), key=lambda i: len(texts[i]) // 8)
        for a in random.permutation(range(0, len(order), batch)).tolist():
            some = order[a : a + batch]
            length = max(len(texts[i]) for i in some)
            x = np.zeros((length, len(some)), dtype=np.uint8)
            y = np.zeros((length, len(some)), dtype=np.int64)
            for j, i in enumerate(some):
                x[: len(texts[i]), j] = classes(texts[i])
                for s, t, kind in spans[i]:
                    y[s:t, j] = kind + 1
            slopes, _ = gradients(model, x, y)
            slopes[-1] = np.where(free, slopes[-1], 0.0)
            step += 1
            pace = rate * min(1.0, 1.5 * (1 - (step - 1) / steps) + 0.05)
            for w, g, m, v in zip(weights, slopes, first, second):
                g = np.clip(g / len(some), -5, 5)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w += (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(w.dtype)
    return model
