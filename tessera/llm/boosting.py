"""Gradient-boosted trees on binned features, and score calibration (NumPy)."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic loss, complete trees of fixed depth, deterministic."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0
        self.knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b, mean = self._binned(x), float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
        self.start = float(np.log(mean / (1 - mean)))
        f = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), dtype=np.int64)
            feature, cut = np.zeros(2**self.depth - 1, dtype=np.int64), np.full(2**self.depth - 1, self.bins, dtype=np.int64)
            for level in range(self.depth):
                first = 2**level - 1
                for k in range(first, 2 * first + 1):
                    at = node == k - first
                    gs, hs = g[at], h[at]
                    best, total = 1e-9, (gs.sum() ** 2) / (hs.sum() + self.ridge)
                    for j in range(x.shape[1]):
                        n = len(self.edges[j]) + 1
                        left_g = np.cumsum(np.bincount(b[at, j], gs, n))[:-1]
                        left_h = np.cumsum(np.bincount(b[at, j], hs, n))[:-1]
                        if not len(left_g):
                            continue
                        gain = left_g**2 / (left_h + self.ridge) + (gs.sum() - left_g) ** 2 / (hs.sum() - left_h + self.ridge) - total
                        i = int(np.argmax(gain))
                        if gain[i] > best:
                            best, feature[k], cut[k] = gain[i], j, i
                picked = first + node
                node = 2 * node + (b[np.arange(len(y)), feature[picked]] > cut[picked])
            size = 2**self.depth
            leaf = self.rate * np.bincount(node, g, size) / (np.bincount(node, h, size) + self.ridge)
            self.trees.append((feature, cut, leaf))
            f = f + leaf[node]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, rows = self._binned(x), np.arange(len(x))
        f = np.full(len(x), self.start)
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for level in range(self.depth):
                k = 2**level - 1 + node
                node = 2 * node + (b[rows, feature[k]] > cut[k])
            f = f + leaf[node]
        return f

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        """Isotonic regression of held-out labels on the margin."""
        return self.calibrate_counts(self.margin(x), y, np.ones(len(y)))

    def calibrate_counts(self, margins: np.ndarray, positive: np.ndarray, count: np.ndarray) -> "Boosted":
        """The same where each margin stands for count labels, positive of which are 1."""
        blocks: list[list[float]] = []  # [mean, weight, margin]
        for i in np.argsort(margins, kind="stable"):
            blocks.append([float(positive[i] / count[i]), float(count[i]), float(margins[i])])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                b, a = blocks.pop(), blocks.pop()
                w = a[1] + b[1]
                blocks.append([(a[0] * a[1] + b[0] * b[1]) / w, w, b[2]])
        if blocks:
            self.knots = (np.array([k[2] for k in blocks]), np.array([(k[0] * k[1] + 0.5) / (k[1] + 1) for k in blocks]))
        return self

    def calibrated(self, margins: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.knots[0], margins, side="left"), len(self.knots[1]) - 1)
        return self.knots[1][at]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated(self.margin(x)) if len(x) else np.zeros(0)
