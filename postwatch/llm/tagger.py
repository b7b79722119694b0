"""Character tagger in numpy: a bidirectional LSTM with CRF transitions, its training, and decoding of windows and chains of them.

A chain is one sequence whose label scores come in cells of equal length. Its best labels are found over the whole chain, not
cell by cell: ``transfers`` gives for each cell the best score from each label of its first place to each of its last,
``joined`` runs along these matrices and settles the first and last label of every cell, ``traced`` fills in between.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: 0: none; 1 + 2 k: begin of kind k; 2 + 2 k: inside of kind k.
LABELS = 1 + 2 * len(KINDS)
HIDDEN = 16
#: Symbols: digits are one, letters count without case, other ASCII as it is, one for all white space, one for all others.
SYMBOLS = 101
_NEVER = np.float32(-1e4)


def _symbols() -> np.ndarray:
    table = np.full(129, 100, np.int64)
    for c in range(33, 127):
        table[c] = 1 if 48 <= c <= 57 else (c + 32 if 65 <= c <= 90 else c) - 31
    table[[9, 10, 11, 12, 13, 32]] = 0
    return table


_TABLE = _symbols()


def symbols(text: str) -> np.ndarray:
    """One symbol per code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.minimum(points, 128)]


def allowed() -> np.ndarray:
    """Which label may follow which: the inside of a kind only after its begin or inside."""
    out = np.ones((LABELS, LABELS), bool)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        out[:, inside] = False
        out[[inside - 1, inside], inside] = True
    return out


_ALLOWED = allowed()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Parameters:
    """Of both directions: symbol to gates, hidden to gates; then hidden to labels, its bias, transitions, first labels."""

    inputs: np.ndarray
    hidden: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    moves: np.ndarray
    first: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.inputs, self.hidden, self.out, self.bias, self.moves, self.first]


def initial(seed: int = 1) -> Parameters:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    inputs = draw(2, SYMBOLS, 4 * HIDDEN, scale=0.3)
    inputs[:, :, HIDDEN : 2 * HIDDEN] += 0.5  # forget gates begin open
    return Parameters(
        inputs,
        draw(2, HIDDEN, 4 * HIDDEN, scale=0.25),
        draw(2 * HIDDEN, LABELS, scale=0.2),
        np.zeros(LABELS, np.float32),
        np.zeros((LABELS, LABELS), np.float32),
        np.zeros(LABELS, np.float32),
    )


def _run(inputs: np.ndarray, hidden: np.ndarray, x: np.ndarray, keep: bool):
    """One direction over x (time, windows): hidden states, and what the backward pass needs."""
    steps, n = x.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    states, saved = np.empty((steps, n, HIDDEN), np.float32), []
    for t in range(steps):
        z = inputs[x[t]]
        z += h @ hidden
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        before = c
        c = f * c + i * g
        squashed = np.tanh(c)
        if keep:
            saved.append((h, before, i, f, o, g, squashed))
        h = o * squashed
        states[t] = h
    return states, saved


def _back(hidden: np.ndarray, x: np.ndarray, saved: list, d_states: np.ndarray, d_inputs: np.ndarray, d_hidden: np.ndarray) -> None:
    """Adds the gradients of one direction."""
    n = x.shape[1]
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    for t in range(len(saved) - 1, -1, -1):
        h, before, i, f, o, g, squashed = saved[t]
        dh = dh + d_states[t]
        dc = dc + dh * o * (1 - squashed * squashed)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g * g)], 1)
        np.add.at(d_inputs, x[t], dz)
        d_hidden += h.T @ dz
        dh, dc = dz @ hidden.T, dc * f


def emissions(p: Parameters, x: np.ndarray, keep: bool = False):
    """Label scores (time, windows, labels) of symbols x (windows, time)."""
    x = x.T
    ahead, saved_ahead = _run(p.inputs[0], p.hidden[0], x, keep)
    back, saved_back = _run(p.inputs[1], p.hidden[1], x[::-1], keep)
    states = np.concatenate([ahead, back[::-1]], 2)
    return states @ p.out + p.bias, states, saved_ahead, saved_back


def _moves(p: Parameters) -> np.ndarray:
    return np.where(_ALLOWED, p.moves, _NEVER)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def loss_and_gradient(p: Parameters, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean negative log-likelihood per window, and its gradient, of labels y (windows, time)."""
    scores, states, saved_ahead, saved_back = emissions(p, x, True)
    steps, n, _ = scores.shape
    moves, rows = _moves(p), np.arange(n)
    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[0] = p.first + scores[0]
    for t in range(1, steps):
        alpha[t] = _log_sum(alpha[t - 1][:, :, None] + moves, 1) + scores[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = _log_sum(moves + (beta[t + 1] + scores[t + 1])[:, None, :], 2)
    total = _log_sum(alpha[-1], 1)
    y = y.T
    own = p.first[y[0]] + scores[0, rows, y[0]]
    d_scores = np.exp(alpha + beta - total[None, :, None])
    d_first = d_scores[0].sum(0)
    np.subtract.at(d_first, y[0], 1)
    d_moves = np.zeros_like(p.moves)
    for t in range(1, steps):
        pair = alpha[t - 1][:, :, None] + moves + (scores[t] + beta[t])[:, None, :] - total[:, None, None]
        d_moves += np.exp(pair).sum(0)
        np.subtract.at(d_moves, (y[t - 1], y[t]), 1)
        own = own + moves[y[t - 1], y[t]] + scores[t, rows, y[t]]
    d_moves[~_ALLOWED] = 0
    d_scores[np.arange(steps)[:, None], rows, y] -= 1
    d_out = np.einsum("tnh,tnl->hl", states, d_scores, optimize=True)
    d_states = d_scores @ p.out.T
    d_inputs, d_hidden = np.zeros_like(p.inputs), np.zeros_like(p.hidden)
    _back(p.hidden[0], x.T, saved_ahead, d_states[:, :, :HIDDEN], d_inputs[0], d_hidden[0])
    _back(p.hidden[1], x.T[::-1], saved_back, d_states[::-1, :, HIDDEN:], d_inputs[1], d_hidden[1])
    gradient = [d_inputs, d_hidden, d_out, d_scores.sum((0, 1)), d_moves, d_first]
    return float((total - own).mean()), [g / n for g in gradient]


def train(x: np.ndarray, y: np.ndarray, steps: int, batch: int, seed: int = 1, rate: float = 0.02) -> Parameters:
    """Adam over random batches; the rate falls to a tenth."""
    p, rng = initial(seed), np.random.default_rng(seed)
    arrays = p.arrays()
    mean, square = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays]
    for step in range(1, steps + 1):
        chosen = rng.integers(0, len(x), batch)
        _, gradient = loss_and_gradient(p, x[chosen], y[chosen])
        norm = np.sqrt(sum(float((g * g).sum()) for g in gradient))
        now = rate * 0.1 ** (step / steps)
        for a, g, m, s in zip(arrays, gradient, mean, square):
            g = g * min(1.0, 5 / (norm + 1e-9))
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            a -= now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return p


def transfers(p: Parameters, scores: np.ndarray) -> np.ndarray:
    """For each cell of scores (time, cells, labels): best path score by label of the first place and of the last."""
    moves = _moves(p)
    best = np.where(np.eye(LABELS, dtype=bool), scores[0][:, None, :], np.float32(-1e6))
    for now in scores[1:]:
        way = best[:, :, :1] + moves[0]
        for b in range(1, LABELS):
            np.maximum(way, best[:, :, b : b + 1] + moves[b], out=way)
        best = way + now[:, None, :]
    return best


def joined(p: Parameters, cells: np.ndarray, fresh: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last label of each cell on the best path of its chain.

    ``cells``: their transfers; ``fresh``: a chain begins here; ``opens``: so does the text, else label 0 stands before the chain;
    ``closes``: the text ends with this cell, else label 0 stands after the chain.
    """
    moves = _moves(p).astype(np.float64)
    n, labels = len(cells), np.arange(LABELS)
    before, enters = np.zeros((n, LABELS), np.int8), np.zeros((n, LABELS), np.int8)
    first, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
    out, at = np.zeros(LABELS), 0
    for k in range(n):
        if fresh[k]:
            into, at = (p.first.astype(np.float64) if opens[k] else moves[0]), k
        else:
            ways = out[:, None] + moves
            before[k] = ways.argmax(0)
            into = ways[before[k], labels]
        ways = into[:, None] + cells[k]
        enters[k] = ways.argmax(0)
        out = ways[enters[k], labels]
        out -= out.max()
        if k + 1 == n or fresh[k + 1]:
            label = int((out if closes[k] else out + moves[:, 0]).argmax())
            for back in range(k, at - 1, -1):
                last[back], first[back] = label, enters[back, label]
                label = before[back, first[back]]
    return first, last


def traced(p: Parameters, scores: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The best labels (cells, time) of each cell between its given first and last label."""
    moves = _moves(p)
    steps, n, _ = scores.shape
    rows = np.arange(n)
    best = np.full((n, LABELS), np.float32(-1e6))
    best[rows, first] = scores[0, rows, first]
    came = np.empty((steps, n, LABELS), np.int8)
    for t in range(1, steps):
        ways = best[:, :, None] + moves
        came[t] = ways.argmax(1)
        best = ways.max(1) + scores[t]
    out = np.empty((n, steps), np.int64)
    out[:, -1] = last
    for t in range(steps - 1, 0, -1):
        out[:, t - 1] = came[t, rows, out[:, t]]
    return out


def decode(p: Parameters, x: np.ndarray) -> np.ndarray:
    """The best label sequence of each window (windows, time)."""
    scores = emissions(p, x)[0]
    moves = _moves(p)
    steps, n, _ = scores.shape
    best, came = p.first + scores[0], np.empty((steps, n, LABELS), np.int8)
    for t in range(1, steps):
        ways = best[:, :, None] + moves
        came[t] = ways.argmax(1)
        best = ways.max(1) + scores[t]
    out = np.empty((n, steps), np.int64)
    out[:, -1] = best.argmax(1)
    for t in range(steps - 1, 0, -1):
        out[:, t - 1] = came[t, np.arange(n), out[:, t]]
    return out
