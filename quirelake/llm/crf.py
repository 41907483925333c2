"""A linear-chain conditional random field in numpy: sequences laid end to end, decoded many at a time."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    """weights[f, y] of active features, trans[x, y] from label x to y, ends[0] and ends[1] for the first and last label."""

    weights: np.ndarray
    trans: np.ndarray
    ends: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        """Label scores of positions whose active features are the rows of features (-1: none)."""
        out = np.zeros((len(features), self.trans.shape[0]))
        for j in range(features.shape[1]):
            f = features[:, j]
            out += np.where((f >= 0)[:, None], self.weights[np.maximum(f, 0)], 0.0)
        return out


def _steps(first: np.ndarray):
    """Sequences by falling length, and for each position how many have it."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    size = size[order]
    most = int(size[0]) if len(size) else 0
    return first[:-1][order], size, np.searchsorted(-size, -np.arange(most), "left")


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def marginals(score: np.ndarray, first: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Forward-backward: label marginals of every position, summed marginals of label pairs, of the ends, and the log partition."""
    k = chain.trans.shape[0]
    at, size, active = _steps(first)
    alpha, beta = np.zeros_like(score), np.zeros_like(score)
    pairs, ends, log_z = np.zeros((k, k)), np.zeros((2, k)), 0.0
    if not len(score):
        return alpha, pairs, ends, log_z
    n = int(active[0])
    alpha[at[:n]] = score[at[:n]] + chain.ends[0]
    for t in range(1, len(active)):
        i = at[: active[t]] + t
        alpha[i] = score[i] + _lse(alpha[i - 1][:, :, None] + chain.trans[None], 1)
    live = size > 0
    last = (at + size - 1)[live]
    beta[last] = chain.ends[1]
    for t in range(len(active) - 2, -1, -1):
        i = at[: active[t + 1]] + t
        beta[i] = _lse(chain.trans[None] + (score[i + 1] + beta[i + 1])[:, None, :], 2)
    z = np.repeat(_lse(alpha[last] + beta[last], 1), size[live])
    where = np.concatenate([np.arange(a, a + s) for a, s in zip(at[live], size[live], strict=True)]) if live.any() else np.zeros(0, int)
    zs = np.zeros(len(score))
    zs[where] = z
    p = np.exp(alpha + beta - zs[:, None])
    inner = np.ones(len(score), bool)
    inner[last] = False
    i = np.flatnonzero(inner)
    for lo in range(0, len(i), 1 << 16):
        j = i[lo : lo + (1 << 16)]
        pairs += np.exp(alpha[j][:, :, None] + chain.trans[None] + (score[j + 1] + beta[j + 1])[:, None, :] - zs[j][:, None, None]).sum(0)
    ends[0], ends[1] = p[at[live]].sum(0), p[last].sum(0)
    return p, pairs, ends, float(_lse(alpha[last] + beta[last], 1).sum())


def viterbi(score: np.ndarray, first: np.ndarray, chain: Chain) -> np.ndarray:
    """The best label of every position."""
    at, size, active = _steps(first)
    best = score.copy()
    back = np.zeros(score.shape, np.int8)
    label = np.zeros(len(score), np.int64)
    if not len(score):
        return label
    n = int(active[0])
    best[at[:n]] += chain.ends[0]
    for t in range(1, len(active)):
        i = at[: active[t]] + t
        m = best[i - 1][:, :, None] + chain.trans[None]
        back[i] = m.argmax(1)
        best[i] += m.max(1)
    live = size > 0
    last = (at + size - 1)[live]
    label[last] = (best[last] + chain.ends[1]).argmax(1)
    for t in range(len(active) - 2, -1, -1):
        i = at[: active[t + 1]] + t
        label[i] = back[i + 1, label[i + 1]]
    return label


def fit(features: np.ndarray, labels: np.ndarray, first: np.ndarray, n_features: int, k: int, rounds: int = 120, rate: float = 0.2, l2: float = 1e-3, start: Chain | None = None) -> Chain:
    """Maximum conditional likelihood by Adam over all sequences; the same input gives the same weights."""
    shapes = [(n_features, k), (k, k), (2, k)]
    params = [x.copy() for x in (start.weights, start.trans, start.ends)] if start else [np.zeros(s) for s in shapes]
    on = features >= 0
    flat = np.where(on, features, n_features)
    size = np.diff(first)
    live = size > 0
    heads, tails = first[:-1][live], first[1:][live] - 1
    gold = [np.zeros((n_features + 1, k)), np.zeros((k, k)), np.zeros((2, k))]
    for j in range(features.shape[1]):
        np.add.at(gold[0], (flat[:, j], labels), 1.0)
    inner = np.ones(len(labels), bool)
    inner[tails] = False
    i = np.flatnonzero(inner)
    np.add.at(gold[1], (labels[i], labels[i + 1]), 1.0)
    np.add.at(gold[2], (0, labels[heads]), 1.0)
    np.add.at(gold[2], (1, labels[tails]), 1.0)
    gold[0] = gold[0][:-1]
    n = max(len(labels), 1)
    m, v = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    for step in range(1, rounds + 1):
        chain = Chain(*params)
        p, pairs, ends, _ = marginals(chain.scores(features), first, chain)
        seen = np.zeros((n_features + 1, k))
        for y in range(k):
            for j in range(features.shape[1]):
                seen[:, y] += np.bincount(flat[:, j], weights=p[:, y], minlength=n_features + 1)
        for x, (g, e) in enumerate(zip(gold, (seen[:-1], pairs, ends), strict=True)):
            grad = (e - g) / n + l2 * params[x]
            m[x] = 0.9 * m[x] + 0.1 * grad
            v[x] = 0.99 * v[x] + 0.01 * grad**2
            params[x] = params[x] - rate * (m[x] / (1 - 0.9**step)) / (np.sqrt(v[x] / (1 - 0.99**step)) + 1e-8)
    return Chain(*params)
