"""Linear-chain conditional random fields in numpy, many chains at a time.

A token has ``S`` sparse features, given as integer columns; a feature of the
previous or next token is a column like any other.  Emission scores are sums
of weight rows, so a batch of tokens is a few gathers.  Chains are grouped by
length and advance together, one position a step; log-space forward-backward
gives marginals and, for training, expected counts, and Viterbi decodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Crf:
    """``emit``: (features, labels); ``move``: (labels, labels); ``start``: (labels,).

    ``tables`` are sorted 64-bit keys, one array for each column; feature
    numbers of a column begin at ``base`` and its first is "not in the table".
    """

    labels: tuple[str, ...]
    tables: tuple[np.ndarray, ...]
    base: tuple[int, ...]
    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def columns(self, keys: list[np.ndarray]) -> list[np.ndarray]:
        """Feature numbers of each column's keys."""
        out = []
        for table, base, key in zip(self.tables, self.base, keys, strict=True):
            if not len(table):
                out.append(np.full(len(key), base))
                continue
            at = np.minimum(np.searchsorted(table, key), len(table) - 1)
            out.append(np.where(table[at] == key, at + base + 1, base))
        return out

    def emissions(self, columns: list[np.ndarray]) -> np.ndarray:
        total = np.zeros((len(columns[0]), len(self.labels)))
        for c in columns:
            total += self.emit[c]
        return total


#: Tokens of a chain at most, which bounds the steps of a batch.
LONGEST = 1024


def limited(new: np.ndarray) -> np.ndarray:
    """Marks of first tokens, with further ones so that no chain has more than ``LONGEST`` tokens."""
    at = np.arange(len(new))
    return new | ((at - np.maximum.accumulate(np.where(new, at, 0))) % LONGEST == 0)


def batches(length: np.ndarray, cells: int = 400_000) -> Iterator[np.ndarray]:
    """Chain numbers in groups of similar length of at most about ``cells`` padded positions."""
    order = np.argsort(length, kind="stable")
    order = order[length[order] > 0]
    at = 0
    while at < len(order):
        size = length[order[at:]]
        fits = int(np.searchsorted(np.maximum.accumulate(size) * (np.arange(len(size)) + 1), cells, "right"))
        close = int(np.searchsorted(size, max(8, size[0] * 1.25), "right"))
        n = max(1, min(fits, close))
        yield order[at : at + n]
        at += n


def _grid(first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers by position and chain, and which of them exist."""
    steps = np.arange(length.max())[:, None]
    there = steps < length[None, :]
    return np.where(there, first[None, :] + steps, first[None, :]), there


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def forward_backward(model: Crf, score: np.ndarray, first: np.ndarray, length: np.ndarray, counts: bool = False) -> tuple[np.ndarray, float, np.ndarray]:
    """Label marginals of every token, total log partition, expected moves."""
    k = len(model.labels)
    marginal = np.zeros((len(score), k))
    moves, total = np.zeros((k, k)), 0.0
    for own in batches(length):
        at, there = _grid(first[own], length[own])
        e = score[at]
        steps, n = at.shape
        a, b = np.empty((steps, n, k)), np.zeros((steps, n, k))
        a[0] = e[0] + model.start
        for t in range(1, steps):
            a[t] = _lse(a[t - 1][:, :, None] + model.move[None], 1) + e[t]
            a[t] = np.where(there[t][:, None], a[t], a[t - 1])
        z = _lse(a[-1], 1)
        total += float(z.sum())
        for t in range(steps - 2, -1, -1):
            step = _lse(model.move[None] + (e[t + 1] + b[t + 1])[:, None, :], 2)
            b[t] = np.where(there[t + 1][:, None], step, 0)
        p = np.exp(a + b - z[None, :, None])
        marginal[at[there]] = p[there]
        if counts and steps > 1:
            pair = np.exp(a[:-1, :, :, None] + model.move[None, None] + (e[1:] + b[1:])[:, :, None, :] - z[None, :, None, None])
            moves += pair[there[1:]].sum(axis=0)
    return marginal, total, moves


def binary_marginal(model: Crf, score: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Marginal of the second of two labels for every token, by scaled forward-backward."""
    m = np.exp(model.move - model.move.max())
    s = np.exp(model.start - model.start.max())
    odds = np.exp(np.clip(score[:, 1] - score[:, 0], -50, 50))
    out = np.zeros(len(score))
    for own in batches(length):
        at, there = _grid(first[own], length[own])
        o = odds[at]
        steps, n = at.shape
        a, b = np.empty((steps, n)), np.ones((steps, n))
        a[0] = o[0] * s[1] / s[0]
        for t in range(1, steps):  # forward odds of label 1
            a[t] = o[t] * (m[0, 1] + a[t - 1] * m[1, 1]) / (m[0, 0] + a[t - 1] * m[1, 0])
        for t in range(steps - 2, -1, -1):  # backward odds
            x = o[t + 1] * b[t + 1]
            b[t] = np.where(there[t + 1], (m[1, 0] + x * m[1, 1]) / (m[0, 0] + x * m[0, 1]), 1.0)
        r = a * b
        out[at[there]] = (r / (1 + r))[there]
    return out


def viterbi(model: Crf, score: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The best label of every token."""
    best = np.zeros(len(score), np.int64)
    for own in batches(length):
        at, there = _grid(first[own], length[own])
        e = score[at]
        steps, n = at.shape
        back = np.zeros((steps, n, len(model.labels)), np.int8)
        v = e[0] + model.start
        for t in range(1, steps):
            way = v[:, :, None] + model.move[None]
            arg = way.argmax(axis=1)
            step = np.take_along_axis(way, arg[:, None, :], 1)[:, 0] + e[t]
            back[t] = np.where(there[t][:, None], arg, np.arange(len(model.labels)))
            v = np.where(there[t][:, None], step, v)
        label = v.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            best[at[t][there[t]]] = label[there[t]]
            label = back[t][np.arange(n), label]
    return best


def train(
    labels: tuple[str, ...],
    keys: list[np.ndarray],
    gold: np.ndarray,
    first: np.ndarray,
    length: np.ndarray,
    rounds: int = 120,
    l2: float = 0.02,
    rate: float = 0.5,
    least: int = 1,
    forbid: tuple[tuple[str, str], ...] = (),
) -> Crf:
    """Maximum likelihood by adaptive gradient steps on all chains.

    A feature enters its column's table if it occurs ``least`` times.  Moves
    in ``forbid`` get a score that no path takes.
    """
    tables, base, at = [], [], 0
    for key in keys:
        values, n = np.unique(key, return_counts=True)
        tables.append(values[n >= least])
        base.append(at)
        at += len(tables[-1]) + 1
    k = len(labels)
    model = Crf(labels, tuple(tables), tuple(base), np.zeros((at, k)), np.zeros((k, k)), np.zeros(k))
    cols = model.columns(keys)
    hot = np.eye(k)[gold]
    closed = np.zeros((k, k), bool)
    for x, y in forbid:
        closed[labels.index(x), labels.index(y)] = True
    model.move[closed] = -30
    seen = np.zeros((k, k))
    inner = np.setdiff1d(np.arange(len(gold)), first[length > 0])
    np.add.at(seen, (gold[inner - 1], gold[inner]), 1)
    begin = first[length > 0]
    state = [np.full_like(x, 1e-6) for x in (model.emit, model.move, model.start)]
    n = max(len(begin), 1)
    for _ in range(rounds):
        marginal, _, moves = forward_backward(model, model.emissions(cols), first, length, counts=True)
        diff = hot - marginal
        grad = np.zeros_like(model.emit)
        for c in cols:
            for y in range(k):
                grad[:, y] += np.bincount(c, diff[:, y], at)
        grads = (grad - l2 * model.emit, np.where(closed, 0, seen - moves - l2 * np.where(closed, 0, model.move)), diff[begin].sum(axis=0) - l2 * model.start)
        for w, g, s in zip((model.emit, model.move, model.start), grads, state, strict=True):
            s += (g / n) ** 2
            w += rate * (g / n) / np.sqrt(s)
    return model
