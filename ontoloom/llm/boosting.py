"""Gradient-boosted trees for two classes, on binned dense features, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of fixed depth in heap order; a row goes right where its value is over the node's."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, trees: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 32, least: float = 5.0, penalty: float = 1.0):
        n, k = x.shape
        self.depth, self.rate = depth, rate
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
        flat = binned + np.arange(k) * bins
        p = np.average(y, weights=w)
        self.start = float(np.log(p / (1 - p))) if 0 < p < 1 else (20.0 if p >= 1 else -20.0)
        raw = np.full(n, self.start)
        self.features, self.values, self.leaves = [], [], []
        for _ in range(trees if 0 < p < 1 else 0):
            s = 1 / (1 + np.exp(-raw))
            grad, hess = w * (y - s), w * s * (1 - s)
            node = np.zeros(n, np.int64)
            feature, value = np.full(2**depth - 1, -1), np.zeros(2**depth - 1)
            for level in range(depth):
                first, width = 2**level - 1, 2**level
                at = (node - first)[:, None] * (k * bins) + flat
                g = np.bincount(at.ravel(), np.repeat(grad, k), width * k * bins).reshape(width, k, bins).cumsum(2)
                h = np.bincount(at.ravel(), np.repeat(hess, k), width * k * bins).reshape(width, k, bins).cumsum(2)
                gt, ht = g[:, :1, -1:], h[:, :1, -1:]
                gain = g**2 / (h + penalty) + (gt - g) ** 2 / (ht - h + penalty) - gt**2 / (ht + penalty)
                gain[(h < least) | (ht - h < least)] = 0
                best = gain.reshape(width, -1).argmax(1)
                for m in range(width):
                    j, b = divmod(int(best[m]), bins)
                    if gain[m, j, b] > 1e-9 and b < len(edges[j]):
                        feature[first + m], value[first + m] = j, edges[j][b]
                f = feature[node]
                right = (f >= 0) & (x[np.arange(n), np.maximum(f, 0)] > value[node])
                node = 2 * node + 1 + right
            leaf = node - (2**depth - 1)
            out = np.bincount(leaf, grad, 2**depth) / (np.bincount(leaf, hess, 2**depth) + penalty)
            raw += rate * out[leaf]
            self.features.append(feature), self.values.append(value), self.leaves.append(out)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds before calibration."""
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, value, leaf in zip(self.features, self.values, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = 2 * node + 1 + ((f >= 0) & (x[rows, np.maximum(f, 0)] > value[node]))
            out += self.rate * leaf[node - (2**self.depth - 1)]
        return out
