"""Histogram gradient-boosted trees in numpy, flattened into arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Trees:
    """Complete binary trees of one depth; node i has children 2i+1 and 2i+2."""

    edges: np.ndarray  # features x (BINS-1)
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # go right where the bin is above this
    leaf: np.ndarray  # trees x leaves
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1).astype(np.int16)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds; all rows step down each tree together."""
        b = self.bins(np.nan_to_num(x))
        rows = np.arange(len(b))
        out = np.full(len(b), self.base)
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(b), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            out += leaf[node - inner]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.2, l2: float = 1.0, least: float = 2.0) -> Trees:
    """Logistic loss, second order, level by level. One class or no rows: a constant near its share."""
    x, y = np.nan_to_num(np.asarray(x, float)), np.asarray(y, float)
    n, width = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    steps = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = np.stack([np.quantile(x[:, f], steps) if n else np.zeros(BINS - 1) for f in range(width)])
    model = Trees(edges, np.zeros((trees, inner), np.int64), np.full((trees, inner), BINS, np.int16), np.zeros((trees, leaves)), base)
    if not n or y.min() == y.max():
        return model
    b = model.bins(x).astype(np.int64)
    score = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            local = (node - first) * BINS
            best = np.zeros(many)
            for f in range(width):
                key = local + b[:, f]
                gl = np.bincount(key, g, many * BINS).reshape(many, BINS).cumsum(axis=1)
                hl = np.bincount(key, h, many * BINS).reshape(many, BINS).cumsum(axis=1)
                ga, ha = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + l2) + (ga - gl) ** 2 / (ha - hl + l2) - ga**2 / (ha + l2)
                gain[(hl < least) | (ha - hl < least)] = 0
                cut = gain.argmax(axis=1)
                gain = gain[np.arange(many), cut]
                better = gain > best + 1e-9
                best = np.where(better, gain, best)
                model.feature[t, first : first + many][better] = f
                model.cut[t, first : first + many][better] = cut[better]
            node = 2 * node + 1 + (b[np.arange(n), model.feature[t, node]] > model.cut[t, node])
        at = node - inner
        model.leaf[t] = -rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + l2)
        score += model.leaf[t, at]
    return model
