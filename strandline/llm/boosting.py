"""Gradient-boosted decision trees for two classes, on binned features, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of equal depth on logistic loss; leaves are Newton steps. ``score`` gives log odds."""

    def __init__(self, n_trees: int = 40, depth: int = 4, rate: float = 0.3, n_bins: int = 32, ridge: float = 1.0):
        self.n_trees, self.depth, self.rate, self.n_bins, self.ridge = n_trees, depth, rate, n_bins, ridge
        self.features: list[np.ndarray] = []
        self.limits: list[np.ndarray] = []
        self.leaves: list[np.ndarray] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, m = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.n_bins + 1)[1:-1])) for j in range(m)]
        bins = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(m)], axis=1)
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        f = np.full(n, self.start)
        columns = np.arange(m) * self.n_bins
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-f))
            grad, hess = p - y, p * (1 - p)
            at = np.zeros(n, np.int64)  # the node of each row, numbered as in a heap
            feature, limit = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                base, width = 2**level - 1, 2**level
                slot = ((at - base)[:, None] * (m * self.n_bins) + columns + bins).ravel()
                size = width * m * self.n_bins
                g = np.bincount(slot, np.repeat(grad, m), size).reshape(width, m, self.n_bins).cumsum(axis=2)
                h = np.bincount(slot, np.repeat(hess, m), size).reshape(width, m, self.n_bins).cumsum(axis=2)
                all_g, all_h = g[:, :, -1:], h[:, :, -1:]
                gain = g**2 / (h + self.ridge) + (all_g - g) ** 2 / (all_h - h + self.ridge) - all_g**2 / (all_h + self.ridge)
                for k in range(width):
                    best = int(gain[k, :, :-1].argmax())
                    j, b = divmod(best, self.n_bins - 1)
                    if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                        feature[base + k], limit[base + k] = j, cuts[j][b]
                at = 2 * at + 1 + (x[np.arange(n), feature[at]] > limit[at])
            leaf = at - (2**self.depth - 1)
            step = -np.bincount(leaf, grad, 2**self.depth) / (np.bincount(leaf, hess, 2**self.depth) + self.ridge)
            self.features.append(feature)
            self.limits.append(limit)
            self.leaves.append(self.rate * step)
            f += self.rate * step[leaf]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        f, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, limit, leaves in zip(self.features, self.limits, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
            f += leaves[at - (2**self.depth - 1)]
        return f
