"""Gradient-boosted trees for a yes-or-no label, on a bounded sample held by the driver."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, histogram splits; trees are complete, as arrays of (feature, cut) by level order."""

    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 48, least_rows: int = 15, ridge: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.least_rows, self.ridge = trees, depth, rate, bins, least_rows, ridge
        self.cuts: list[np.ndarray] = []
        self.splits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)]).astype(np.int16)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> BoostedTrees:
        quantiles = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(x[:, j], quantiles)) for j in range(x.shape[1])]
        codes = self.binned(x).astype(np.int64)
        n, width, inner = x.shape[1], self.bins + 1, 2**self.depth - 1
        mean = float(np.average(y, weights=weight))
        self.base = float(np.log(max(mean, 1e-6) / max(1 - mean, 1e-6)))
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            slope, curve = weight * (p - y), weight * p * (1 - p)
            feature, cut = np.zeros(inner, np.int64), np.full(inner, width, np.int64)
            place = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, nodes = 2**level - 1, 2**level
                local = place - first
                best = np.full(nodes, 1e-6)
                for j in range(n):
                    at = local * width + codes[:, j]
                    g, h, c = (np.bincount(at, w, nodes * width).reshape(nodes, width).cumsum(1) for w in (slope, curve, None))
                    total_g, total_h, total_c = g[:, -1:], h[:, -1:], c[:, -1:]
                    gain = g**2 / (h + self.ridge) + (total_g - g) ** 2 / (total_h - h + self.ridge) - total_g**2 / (total_h + self.ridge)
                    gain[(c < self.least_rows) | (total_c - c < self.least_rows)] = 0
                    top = gain.argmax(1)
                    value = gain[np.arange(nodes), top]
                    better = value > best
                    best[better] = value[better]
                    feature[first : first + nodes][better] = j
                    cut[first : first + nodes][better] = top[better]
                place = 2 * place + 1 + (codes[np.arange(len(y)), feature[place]] > cut[place])
            leaf = place - inner
            g, h = np.bincount(leaf, slope, inner + 1), np.bincount(leaf, curve, inner + 1)
            values = -self.rate * g / (h + self.ridge)
            self.splits.append((feature, cut, values))
            score += values[leaf]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        codes = self.binned(x)
        rows, inner = np.arange(len(x)), 2**self.depth - 1
        score = np.full(len(x), self.base)
        for feature, cut, values in self.splits:
            place = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                place = 2 * place + 1 + (codes[rows, feature[place]] > cut[place])
            score += values[place - inner]
        return score
