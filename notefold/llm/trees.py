"""Gradient-boosted trees for a yes/no target: histogram splits on binned features, logistic loss. Numpy only."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """``fit(x, y, weight)``, ``score(x)`` (log odds), and ``dump``/``load`` as plain lists."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, least: float = 8.0, penalty: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.penalty = trees, depth, rate, bins, least, penalty
        self.edges: list[np.ndarray] = []
        self.base = 0.0
        self.splits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # feature, threshold bin, leaf values

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1).astype(np.uint8)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        weight = np.ones(len(y)) if weight is None else weight
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = self._binned(x)
        share = np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        margin, self.splits = np.full(len(y), self.base), []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = weight * (y - p), weight * p * (1 - p)
            tree = self._grow(binned, grad, hess)
            self.splits.append(tree)
            margin += self._leaf(tree, binned)
        return self

    def _grow(self, binned: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inner = 2**self.depth - 1
        feature, cut = np.zeros(inner, np.int16), np.full(inner, 255, np.int16)
        node, width = np.zeros(len(grad), np.int64), self.bins + 1
        for level in range(self.depth):
            first, count = 2**level - 1, 2**level
            local = node - first
            best = np.full(count, 1e-6)
            total_g, total_h = np.bincount(local, grad, count), np.bincount(local, hess, count)
            whole = total_g**2 / (total_h + self.penalty)
            for j in range(binned.shape[1]):
                slot = local * width + binned[:, j]
                g = np.bincount(slot, grad, count * width).reshape(count, width).cumsum(1)[:, :-1]
                h = np.bincount(slot, hess, count * width).reshape(count, width).cumsum(1)[:, :-1]
                rg, rh = total_g[:, None] - g, total_h[:, None] - h
                gain = g**2 / (h + self.penalty) + rg**2 / (rh + self.penalty) - whole[:, None]
                gain[(h < self.least / 8) | (rh < self.least / 8)] = 0
                at = gain.argmax(1)
                top = gain[np.arange(count), at]
                better = top > best
                best[better] = top[better]
                feature[first : first + count][better] = j
                cut[first : first + count][better] = at[better]
            node = 2 * node + 1 + (binned[np.arange(len(node)), feature[node]] > cut[node])
        leaves = 2**self.depth
        g, h = np.bincount(node - inner, grad, leaves), np.bincount(node - inner, hess, leaves)
        return feature, cut, self.rate * g / (h + self.penalty)

    def _leaf(self, tree: tuple, binned: np.ndarray) -> np.ndarray:
        feature, cut, values = tree
        node, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
        for _ in range(self.depth):
            node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
        return values[node - (2**self.depth - 1)]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        binned = self._binned(x)
        return self.base + sum((self._leaf(t, binned) for t in self.splits), np.zeros(len(x)))

    def dump(self) -> dict:
        return {"base": self.base, "depth": self.depth, "edges": [e.tolist() for e in self.edges], "trees": [[p.tolist() for p in t] for t in self.splits]}

    @staticmethod
    def load(data: dict) -> BoostedTrees:
        model = BoostedTrees(depth=data["depth"])
        model.base, model.edges = data["base"], [np.array(e) for e in data["edges"]]
        model.splits = [(np.array(f, np.int16), np.array(c, np.int16), np.array(v)) for f, c, v in data["trees"]]
        return model
