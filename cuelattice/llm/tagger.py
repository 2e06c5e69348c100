"""A small character tagger: bidirectional LSTM with CRF transitions, trained and run in numpy."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Characters are read as classes: ASCII signs for themselves, letters and digits by kind.
SIGNS = " !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LOWER, UPPER, DIGIT, BREAK, LETTER, OTHER = range(1 + len(SIGNS), 7 + len(SIGNS))
CLASSES = 7 + len(SIGNS)


@lru_cache(maxsize=1)
def _class_table() -> np.ndarray:
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for point in range(0x80, 0x30000):
        if chr(point).isalpha():
            table[point] = LETTER
    for k, sign in enumerate(SIGNS):
        table[ord(sign)] = 1 + k
    table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1], table[ord("0") : ord("9") + 1] = LOWER, UPPER, DIGIT
    for sign in "\t\n\r\x0b\x0c":
        table[ord(sign)] = BREAK
    return table


def classes(text: str) -> np.ndarray:
    return _class_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


@dataclass
class Tagger:
    """Parameters by name, and the tags: O first, then begin and inside of each kind."""

    tags: tuple[str, ...]
    weights: dict[str, np.ndarray]


def tag_names(kinds: Sequence[str]) -> tuple[str, ...]:
    return ("O", *[f"{place}-{kind}" for kind in kinds for place in "BI"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _run(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """LSTM over (time, batch, features); outputs, and what the gradient needs if ``keep``."""
    steps, batch, _ = x.shape
    n = u.shape[0]
    h, c = np.zeros((batch, n), np.float32), np.zeros((batch, n), np.float32)
    inputs = x @ w + b
    out, trace = np.empty((steps, batch, n), np.float32), []
    for t in range(steps):
        z = inputs[t] + h @ u
        gates = _sigmoid(z[:, : 3 * n])
        i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
        g = np.tanh(z[:, 3 * n :])
        if keep:
            trace.append((h, c, i, f, o, g))
        c = f * c + i * g
        h = o * np.tanh(c)
        out[t] = h
    return out, trace


def _run_back(x: np.ndarray, w: np.ndarray, u: np.ndarray, trace: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    steps, n = len(trace), u.shape[0]
    dz = np.empty((*grad.shape[:2], 4 * n), np.float32)
    dh, dc, du = np.zeros_like(grad[0]), np.zeros_like(grad[0]), np.zeros_like(u)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g = trace[t]
        own = np.tanh(f * c + i * g)
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - own * own)
        dz[t] = np.concatenate((dc * g * i * (1 - i), dc * c * f * (1 - f), dh * own * o * (1 - o), dc * i * (1 - g * g)), axis=1)
        du += h.T @ dz[t]
        dh, dc = dz[t] @ u.T, dc * f
    flat = dz.reshape(-1, 4 * n)
    return dz @ w.T, x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(0)


def emissions(tagger: Tagger, points: np.ndarray, keep: bool = False):
    """Tag scores (time, batch, tags) of class rows (batch, time)."""
    p = tagger.weights
    x = p["embed"][points.T]
    ahead, trace_a = _run(x, p["wa"], p["ua"], p["ba"], keep)
    back, trace_b = _run(x[::-1], p["wb"], p["ub"], p["bb"], keep)
    both = np.concatenate((ahead, back[::-1]), axis=2)
    scores = both @ p["out"] + p["bias"]
    return (scores, (x, both, trace_a, trace_b)) if keep else scores


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def _crf_gradient(scores: np.ndarray, tags: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of (batch, time) tags and its gradients, by the forward-backward sums."""
    steps, batch, n = scores.shape
    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[0] = scores[0] + start
    for t in range(1, steps):
        alpha[t] = scores[t] + _log_sum(alpha[t - 1][:, :, None] + move, 1)
    for t in range(steps - 2, -1, -1):
        beta[t] = _log_sum(move + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
    total = _log_sum(alpha[-1], 1)
    rows = np.arange(batch)
    gold = start[tags[:, 0]] + sum(scores[t, rows, tags[:, t]] for t in range(steps)) + sum(move[tags[:, t - 1], tags[:, t]] for t in range(1, steps))
    ds = np.exp(alpha + beta - total[None, :, None])
    dm = np.zeros_like(move)
    for t in range(1, steps):
        dm += np.exp(alpha[t - 1][:, :, None] + move + (scores[t] + beta[t])[:, None, :] - total[:, None, None]).sum(0)
        np.subtract.at(dm, (tags[:, t - 1], tags[:, t]), 1)
    for t in range(steps):
        ds[t, rows, tags[:, t]] -= 1
    return float((total - gold).mean()), ds / batch, ds[0].sum(0) / batch, dm / batch


def train_tagger(kinds: Sequence[str], points: np.ndarray, tags: np.ndarray, hidden: int = 20, embed: int = 12, steps: int = 160, batch: int = 48, rate: float = 0.02, seed: int = 1) -> Tagger:
    """Fit a tagger to class rows and tag rows (windows, time) with Adam; the same rows give the same tagger."""
    rng = np.random.default_rng(seed)
    names = tag_names(kinds)
    shapes = {"embed": (CLASSES, embed), "wa": (embed, 4 * hidden), "ua": (hidden, 4 * hidden), "ba": (4 * hidden,), "wb": (embed, 4 * hidden), "ub": (hidden, 4 * hidden), "bb": (4 * hidden,), "out": (2 * hidden, len(names)), "bias": (len(names),), "start": (len(names),), "move": (len(names), len(names))}
    p = {k: (rng.standard_normal(s) * (0.5 if k == "embed" else 0.15 if len(s) > 1 else 0)).astype(np.float32) for k, s in shapes.items()}
    for k in ("ba", "bb"):
        p[k][hidden : 2 * hidden] = 1
    # What can't follow stays impossible: inside of a kind only after its begin or inside.
    barred = np.zeros((len(names), len(names)), bool)
    for j, name in enumerate(names):
        if name[0] == "I":
            barred[:, j] = [other[2:] != name[2:] or other == "O" for other in names]
    shut = np.array([name[0] == "I" for name in names])
    tagger, m, v = Tagger(names, p), {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    p["move"][barred], p["start"][shut] = -1e4, -1e4
    for step in range(1, steps + 1):
        own = rng.integers(0, len(points), batch)
        scores, (x, both, trace_a, trace_b) = emissions(tagger, points[own], keep=True)
        _, ds, d_start, d_move = _crf_gradient(scores, tags[own], p["start"], p["move"])
        ds = ds.astype(np.float32)
        g = {"out": both.reshape(-1, 2 * hidden).T @ ds.reshape(-1, len(names)), "bias": ds.sum((0, 1)), "start": np.where(shut, 0, d_start), "move": np.where(barred, 0, d_move)}
        d_both = ds @ p["out"].T
        dx_a, g["wa"], g["ua"], g["ba"] = _run_back(x, p["wa"], p["ua"], trace_a, d_both[:, :, :hidden])
        dx_b, g["wb"], g["ub"], g["bb"] = _run_back(x[::-1], p["wb"], p["ub"], trace_b, d_both[::-1, :, hidden:])
        g["embed"] = np.zeros_like(p["embed"])
        np.add.at(g["embed"], points[own].T, dx_a + dx_b[::-1])
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        for k in p:
            grad = g[k] * min(1.0, 5.0 / max(norm, 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.99 * v[k] + 0.01 * grad * grad
            pace = rate * min(1.0, 2 * (1 - (step - 1) / steps))
            p[k] -= (pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return tagger


def best_tags(tagger: Tagger, scores: list[np.ndarray]) -> list[np.ndarray]:
    """Viterbi over several score tables (time, tags), many at a time; step t handles all that are longer than t."""
    if not scores:
        return []
    start, move = tagger.weights["start"], tagger.weights["move"]
    order = sorted(range(len(scores)), key=lambda k: -len(scores[k]))
    lengths = np.array([len(scores[k]) for k in order])
    firsts = np.cumsum(lengths) - lengths
    flat = np.concatenate([scores[k] for k in order])
    came = np.zeros(flat.shape, dtype=np.uint8)
    value = flat[firsts] + start
    alive = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    for t in range(1, lengths[0]):
        n = alive[t]
        options = value[:n, :, None] + move
        came[firsts[:n] + t] = options.argmax(1)
        value[:n] = options.max(1) + flat[firsts[:n] + t]
    state, tags = value.argmax(1), np.zeros(len(flat), dtype=np.uint8)
    for t in range(lengths[0] - 1, -1, -1):
        n = alive[t]
        tags[firsts[:n] + t] = state[:n]
        state[:n] = came[firsts[:n] + t, state[:n]]
    found: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(scores)
    for k, first, length in zip(order, firsts, lengths, strict=True):
        found[k] = tags[first : first + length]
    return found
