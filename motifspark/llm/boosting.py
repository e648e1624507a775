"""Small gradient-boosted trees for binary targets, on binned features (numpy)."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss; complete trees of one depth; splits on quantile bins."""

    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 16, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.l2 = trees, depth, rate, bins, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        self.cuts = [self._cuts(x[:, j]) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], 1)
        score, self.model = np.full(len(y), self.base), []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node, splits = np.zeros(len(y), np.int64), []
            for level in range(self.depth):
                at, first = [], 2**level
                for k in range(first):
                    at.append(self._split(binned[node == k], g[node == k], h[node == k]))
                feature, cut = (np.array(v) for v in zip(*at, strict=True))
                splits.append((feature, cut))
                node = 2 * node + (binned[np.arange(len(y)), feature[node]] > cut[node])
            size = 2**self.depth
            leaf = np.bincount(node, g, size) / (np.bincount(node, h, size) + self.l2) * self.rate
            self.model.append((splits, leaf))
            score += leaf[node]
        return self

    def _cuts(self, x: np.ndarray) -> np.ndarray:
        """Between all values where they are few, so that rare ones count too; else quantiles."""
        values = np.unique(x)
        return (values[1:] + values[:-1]) / 2 if len(values) <= self.bins else np.unique(np.quantile(x, np.linspace(0, 1, self.bins + 1)[1:-1]))

    def _split(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int]:
        best, out = 1e-9, (0, self.bins)
        total_g, total_h = g.sum(), h.sum()
        for j in range(b.shape[1]):
            gl, hl = np.cumsum(np.bincount(b[:, j], g, self.bins)), np.cumsum(np.bincount(b[:, j], h, self.bins))
            gain = gl**2 / (hl + self.l2) + (total_g - gl) ** 2 / (total_h - hl + self.l2) - total_g**2 / (total_h + self.l2)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, out = gain[k], (j, k)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], 1)
        score, row = np.full(len(x), self.base), np.arange(len(x))
        for splits, leaf in self.model:
            node = np.zeros(len(x), np.int64)
            for feature, cut in splits:
                node = 2 * node + (binned[row, feature[node]] > cut[node])
            score += leaf[node]
        return 1 / (1 + np.exp(-score))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, share of ones) of the non-decreasing step function nearest to y, by pooling adjacent violators."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, first and last score
    for s, t in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([t, 1.0, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a, w, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a, blocks[-1][1] + w, blocks[-1][2], last]
    if not blocks:
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    x = [v for _, _, a, b in blocks for v in (a, b)]
    return np.array(x), np.array([a / w for a, w, _, _ in blocks for _ in range(2)])
