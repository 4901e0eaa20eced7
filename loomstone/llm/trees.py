"""Gradient-boosted trees over dense features, with histograms, in numpy.

Fitted on the driver on a bounded sample; scoring is vectorised and runs on the
executors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Tree:
    """Complete binary tree of fixed depth: a feature and a threshold per inner node, a value per leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        for _ in range(int(np.log2(len(self.value)))):
            at = 2 * at + 1 + (x[rows, self.feature[at]] > self.threshold[at])
        return self.value[at - len(self.feature)]


@dataclass
class Boosted:
    bias: float
    trees: list[Tree] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for tree in self.trees:
            out += tree(x)
        return out

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(x))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 1.0, ridge: float = 1.0) -> Boosted:
    """Logistic loss, second-order leaf values. One class or no rows give a constant model."""
    n = len(y)
    share = float(np.clip(y.mean() if n else 0.5, 0.01, 0.99))
    model = Boosted(float(np.log(share / (1 - share))))
    if n == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    z = np.full(n, model.bias)
    for _ in range(rounds):
        p = sigmoid(z)
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        inner = (1 << depth) - 1
        feature, threshold, value = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), np.zeros(1 << depth)
        node = np.zeros(n, dtype=np.int64)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            best = (1e-6, -1, 0)
            if len(rows) >= 2:
                g, h = grad[rows], hess[rows]
                whole = g.sum() ** 2 / (h.sum() + ridge)
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    gl = np.cumsum(np.bincount(code[rows, j], g, len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(code[rows, j], h, len(e) + 1))[:-1]
                    gr, hr = g.sum() - gl, h.sum() - hl
                    gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - whole, -1)
                    i = int(np.argmax(gain))
                    if gain[i] > best[0]:
                        best = (float(gain[i]), j, i)
            right = np.zeros(n, dtype=bool)
            if best[1] >= 0:
                feature[k], threshold[k] = best[1], edges[best[1]][best[2]]
                right[rows] = code[rows, best[1]] > best[2]
            node[rows] = 2 * k + 1 + right[rows]
        leaf = node - inner
        value = -rate * np.bincount(leaf, grad, 1 << depth) / (np.bincount(leaf, hess, 1 << depth) + ridge)
        model.trees.append(Tree(feature, threshold, value))
        z += value[leaf]
    return model


@dataclass
class Isotonic:
    """Steps that rise with the score, joined by straight lines."""

    at: np.ndarray
    to: np.ndarray

    def __call__(self, s: np.ndarray) -> np.ndarray:
        return np.interp(s, self.at, self.to) if len(self.at) else np.full(len(s), 0.5)


def calibrate(score: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; equal scores are one step. Ends are held at half an observation from 0 and 1."""
    if not len(y):
        return Isotonic(np.zeros(0), np.zeros(0))
    at, inverse = np.unique(score, return_inverse=True)
    weight, total = np.bincount(inverse).astype(float), np.bincount(inverse, y)
    blocks: list[list[float]] = []  # lowest, highest, weight, total
    for s, w, t in zip(at, weight, total, strict=True):
        blocks.append([s, s, w, t])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            _, high, w, t = blocks.pop()
            blocks[-1][1:] = [high, blocks[-1][2] + w, blocks[-1][3] + t]
    ends = [(e, min(max(t / w, 0.5 / (w + 1)), 1 - 0.5 / (w + 1))) for low, high, w, t in blocks for e in ((low,) if low == high else (low, high))]
    return Isotonic(np.array([e for e, _ in ends]), np.maximum.accumulate(np.array([v for _, v in ends])))
