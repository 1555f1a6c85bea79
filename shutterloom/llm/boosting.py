"""Gradient-boosted trees for two classes, small enough to travel in a closure: numpy only, histogram splits."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic loss, trees of a fixed depth over quantile bins. Fitted on the driver from a bounded sample."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        self.base = float(np.log(share / (1 - share)))
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
        b, f = self._binned(x), np.full(len(x), self.base)
        for _ in range(self.rounds if len(x) else 0):
            p = 1 / (1 + np.exp(-f))
            tree = self._tree(b, p - y, np.maximum(p * (1 - p), 1e-9))
            self.trees.append(tree)
            f += self.rate * tree[2][self._leaf(b, tree)]
        return self

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        inner = (1 << self.depth) - 1
        feature, split, value = np.zeros(inner, int), np.full(inner, self.bins + 1), np.zeros(1 << self.depth)
        node = np.zeros(len(b), int)
        for k in range(inner):
            at = np.flatnonzero(node == k)
            gain, total_g, total_h = 1e-6, g[at].sum(), h[at].sum()
            for j in range(b.shape[1]):
                left_g = np.cumsum(np.bincount(b[at, j], g[at], self.bins + 1))[:-1]
                left_h = np.cumsum(np.bincount(b[at, j], h[at], self.bins + 1))[:-1]
                right_g, right_h = total_g - left_g, total_h - left_h
                got = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - total_g**2 / (total_h + 1)
                got[(left_h < self.least) | (right_h < self.least)] = -1
                if len(got) and got.max() > gain:
                    gain, feature[k], split[k] = got.max(), j, int(got.argmax())
            node[at] = 2 * k + 1 + (b[at, feature[k]] > split[k])
        leaf = node - inner
        value = -np.bincount(leaf, g, 1 << self.depth) / (np.bincount(leaf, h, 1 << self.depth) + 1)
        return feature, split, value

    def _leaf(self, b: np.ndarray, tree) -> np.ndarray:
        feature, split, _ = tree
        node = np.zeros(len(b), int)
        for _ in range(self.depth):
            node = 2 * node + 1 + (b[np.arange(len(b)), feature[node]] > split[node])
        return node - len(feature)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        if not len(x):
            return np.zeros(0)
        b, f = self._binned(x), np.full(len(x), self.base)
        for tree in self.trees:
            f += self.rate * tree[2][self._leaf(b, tree)]
        return 1 / (1 + np.exp(-f))
