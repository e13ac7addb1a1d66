"""Gradient-boosted trees for small training sets held in memory (logistic loss, histogram splits, second-order gains)."""

from __future__ import annotations

import numpy as np


class Trees:
    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, smooth: float = 1.0, least: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.smooth, self.least = rounds, depth, rate, bins, smooth, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins)))[:-1] for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1)
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(share / (1 - share)))
        raw = np.full(len(y), self.base)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(binned, p - y, p * (1 - p))
            self.trees.append(tree)
            raw += tree[2][self._leaf(tree, binned)]
        return self

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray):
        """A full binary tree: feature and last bin to the left of each inner node (-1: all left), value of each leaf."""
        inner = 2**self.depth - 1
        feature, cut = np.full(inner, -1), np.zeros(inner, dtype=np.int64)
        node = np.zeros(len(g), dtype=np.int64)
        score = lambda a, b: a * a / (b + self.smooth)
        for level in range(self.depth):
            first, many = 2**level - 1, 2**level
            best = np.full(many, 1e-6)
            for f in range(binned.shape[1]):
                at = (node - first) * self.bins + binned[:, f]
                gs = np.bincount(at, g, many * self.bins).reshape(many, -1).cumsum(axis=1)
                hs = np.bincount(at, h, many * self.bins).reshape(many, -1).cumsum(axis=1)
                gain = score(gs, hs) + score(gs[:, -1:] - gs, hs[:, -1:] - hs) - score(gs[:, -1:], hs[:, -1:])
                gain[(hs < self.least / 10) | (hs[:, -1:] - hs < self.least / 10)] = 0
                top = gain.argmax(axis=1)
                better = gain[np.arange(many), top] > best
                best[better] = gain[np.arange(many), top][better]
                feature[first : first + many][better], cut[first : first + many][better] = f, top[better]
            f = feature[node]
            right = (f >= 0) & (binned[np.arange(len(g)), np.maximum(f, 0)] > cut[node])
            node = 2 * node + 1 + right
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        return feature, cut, -self.rate * gs / (hs + self.smooth)

    def _leaf(self, tree, binned: np.ndarray) -> np.ndarray:
        feature, cut, _ = tree
        node, rows = np.zeros(len(binned), dtype=np.int64), np.arange(len(binned))
        for _ in range(self.depth):
            f = feature[node]
            node = 2 * node + 1 + ((f >= 0) & (binned[rows, np.maximum(f, 0)] > cut[node]))
        return node - len(feature)

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1)
        raw = np.full(len(x), self.base)
        for tree in self.trees:
            raw += tree[2][self._leaf(tree, binned)]
        return 1 / (1 + np.exp(-raw))
