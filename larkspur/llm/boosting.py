"""Gradient-boosted regression trees for a yes/no question, in arrays."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic boosting with depth-limited trees over binned features.

    Trees are complete binary trees in arrays: node ``i`` has the children ``2i + 1`` and ``2i + 2``.  Each tree's cuts are chosen on a
    random ``share`` of the rows, its leaves' values on all of them.
    """

    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 2.0, share: float = 0.4) -> None:
        self.trees, self.depth, self.rate, self.bins, self.least, self.share = trees, depth, rate, bins, least, share
        self.feature = np.zeros((0, 2**depth - 1), np.int32)
        self.cut = np.zeros((0, 2**depth - 1))
        self.value = np.zeros((0, 2**depth))
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, width = x.shape
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(width)], 1)
        self.base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
        margin = np.full(n, self.base)
        features, cuts, values = [], [], []
        rng = np.random.default_rng(7)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            gradient, weight = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            drawn = rng.random(n) < (self.share if n > 2000 else 1)
            feature, cut = np.zeros(2**self.depth - 1, np.int32), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                first = 2**level - 1
                for k in range(2**level):
                    rows = np.flatnonzero((node == first + k) & drawn)
                    if len(rows) >= 2:
                        f, b = self._best(binned[rows], gradient[rows], weight[rows])
                        if f >= 0:
                            feature[first + k], cut[first + k] = f, edges[f][b]
                right = x[np.arange(n), feature[node]] > cut[node]
                node = 2 * node + 1 + right
            leaf = node - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, gradient, 2**self.depth) / (np.bincount(leaf, weight, 2**self.depth) + 1)
            margin += value[leaf]
            features.append(feature)
            cuts.append(cut)
            values.append(value)
        self.feature, self.cut, self.value = np.array(features), np.array(cuts), np.array(values)
        return self

    def _best(self, binned: np.ndarray, gradient: np.ndarray, weight: np.ndarray) -> tuple[int, int]:
        best, where = 1e-9, (-1, 0)
        total_g, total_w = gradient.sum(), weight.sum()
        for f in range(binned.shape[1]):
            g = np.cumsum(np.bincount(binned[:, f], gradient, self.bins))[:-1]
            w = np.cumsum(np.bincount(binned[:, f], weight, self.bins))[:-1]
            gain = g * g / (w + 1) + (total_g - g) ** 2 / (total_w - w + 1) - total_g**2 / (total_w + 1)
            gain[(w < self.least / 4) | (total_w - w < self.least / 4)] = 0
            b = int(np.argmax(gain))
            if gain[b] > best:
                best, where = gain[b], (f, b)
        return where

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out
