"""Gradient-boosted trees for binary labels: logistic loss, quantile bins, fixed depth."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    depth: int = 3
    trees: int = 60
    rate: float = 0.2
    bins: int = 32
    l2: float = 1.0
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    feature: np.ndarray = None  # (trees, 2**depth - 1)
    bound: np.ndarray = None  # a row goes right where its bin exceeds this
    leaf: np.ndarray = None  # (trees, 2**depth)
    scale: tuple[float, float] = (1.0, 0.0)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        b, nodes = self._binned(x), 2**self.depth - 1
        self.feature, self.bound = np.zeros((self.trees, nodes), int), np.full((self.trees, nodes), self.bins)
        self.leaf = np.zeros((self.trees, nodes + 1))
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        z = np.full(len(y), self.base)
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-z))
            g, h, at = y - p, p * (1 - p), np.zeros(len(y), int)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                best = np.full(width, 1e-9)
                for f in range(x.shape[1]):
                    key = at * (self.bins + 1) + b[:, f]
                    gs = np.bincount(key, g, width * (self.bins + 1)).reshape(width, -1).cumsum(1)
                    hs = np.bincount(key, h, width * (self.bins + 1)).reshape(width, -1).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                    k = gain[:, :-1].argmax(1)
                    top = gain[np.arange(width), k]
                    for n in np.flatnonzero(top > best + 1e-9):
                        best[n], self.feature[t, first + n], self.bound[t, first + n] = top[n], f, k[n]
                node = first + at
                at = at * 2 + (b[np.arange(len(y)), self.feature[t, node]] > self.bound[t, node])
            gs, hs = np.bincount(at, g, nodes + 1), np.bincount(at, h, nodes + 1)
            self.leaf[t] = self.rate * gs / (hs + self.l2)
            z += self.leaf[t][at]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, z, rows = self._binned(x), np.full(len(x), self.base), np.arange(len(x))
        for t in range(self.trees):
            at = np.zeros(len(x), int)
            for level in range(self.depth):
                node = 2**level - 1 + at
                at = at * 2 + (b[rows, self.feature[t, node]] > self.bound[t, node])
            z += self.leaf[t][at]
        return z

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 200) -> Boosted:
        """Platt scaling on rows that fit() has not seen."""
        z, a, c = self.raw(x), 1.0, 0.0
        t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        for _ in range(steps):  # Newton
            p = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
            g, w = p - t, p * (1 - p) + 1e-9
            grad, hess = np.array([(g * z).sum(), g.sum()]), np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            d = np.linalg.solve(hess, grad)
            a, c = a - d[0], c - d[1]
            if np.abs(d).max() < 1e-8:
                break
        self.scale = (float(a), float(c))
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * self.raw(x) + self.scale[1], -30, 30)))
