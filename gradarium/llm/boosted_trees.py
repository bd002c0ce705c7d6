"""Gradient-boosted trees with logistic loss, in numpy, for small feature matrices."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of equal depth; a node at place i has its children at 2i + 1 and 2i + 2. Each tree is grown on a random share
    of the rows."""

    def __init__(self, n_trees: int = 90, depth: int = 4, rate: float = 0.3, bins: int = 32, l2: float = 1.0, least: float = 2.0, share: float = 0.3):
        self.n_trees, self.depth, self.rate, self.bins, self.l2, self.least, self.share = n_trees, depth, rate, bins, l2, least, share

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, m = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(m)], 1)
        self.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        inner = 2**self.depth - 1
        self.feature = np.zeros((self.n_trees, inner), np.int64)
        self.threshold = np.full((self.n_trees, inner), np.inf)
        self.leaf = np.zeros((self.n_trees, inner + 1))
        margin = np.full(n, self.bias)
        shift, random = np.arange(m) * self.bins, np.random.default_rng(1)
        for t in range(self.n_trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            at = np.zeros(n, np.int64)
            own = random.permutation(n)[: max(1, round(n * self.share))]
            cells, g_own, h_own = shift + binned[own], np.repeat(g[own], m), np.repeat(h[own], m)
            for d in range(self.depth):
                first, width = 2**d - 1, 2**d
                cell = ((at[own] - first)[:, None] * (m * self.bins) + cells).ravel()
                size = width * m * self.bins
                G = np.bincount(cell, g_own, size).reshape(width, m, self.bins).cumsum(2)
                H = np.bincount(cell, h_own, size).reshape(width, m, self.bins).cumsum(2)
                g_all, h_all = G[:, :1, -1:], H[:, :1, -1:]
                gain = G**2 / (H + self.l2) + (g_all - G) ** 2 / (h_all - H + self.l2) - g_all**2 / (h_all + self.l2)
                gain[(H < self.least) | (h_all - H < self.least)] = 0
                best = gain.reshape(width, -1).argmax(1)
                value = gain.reshape(width, -1).max(1)
                for k in range(width):
                    j, b = divmod(int(best[k]), self.bins)
                    if value[k] > 1e-6 and b < len(edges[j]):
                        self.feature[t, first + k], self.threshold[t, first + k] = j, edges[j][b]
                at = 2 * at + 1 + (x[np.arange(n), self.feature[t, at]] > self.threshold[t, at])
            G, H = (np.bincount(at - inner, v, inner + 1) for v in (g, h))
            self.leaf[t] = self.rate * G / (H + self.l2)
            margin += self.leaf[t, at - inner]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows, inner = np.full(len(x), self.bias), np.arange(len(x)), 2**self.depth - 1
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - inner]
        return out
