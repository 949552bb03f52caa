"""Gradient-boosted regression trees for two classes, on numpy arrays."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Depth-limited trees on binned features, fitted to the logistic loss by Newton steps."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.l2 = trees, depth, rate, bins, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)], 1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, self.nodes = np.log(p / (1 - p)), []
        z = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-z))
            tree: dict = {}
            self._grow(tree, 1, np.arange(len(y)), binned, y - p, p * (1 - p), 0)
            self.nodes.append(tree)
            z += self.rate * self._tree(tree, x)
        return self

    def _grow(self, tree: dict, node: int, rows: np.ndarray, binned: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> None:
        gs, hs = g[rows].sum(), h[rows].sum()
        tree[node] = (-1, 0.0, gs / (hs + self.l2))
        if depth >= self.depth or len(rows) < 8:
            return
        best = (1e-3, -1, 0)
        for f in range(binned.shape[1]):
            n = len(self.edges[f]) + 1
            gl = np.cumsum(np.bincount(binned[rows, f], g[rows], n))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, f], h[rows], n))[:-1]
            if len(gl):
                gain = gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - gs**2 / (hs + self.l2)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
        _, f, k = best
        if f < 0:
            return
        left = binned[rows, f] <= k
        tree[node] = (f, float(self.edges[f][k]), 0.0)
        self._grow(tree, 2 * node, rows[left], binned, g, h, depth + 1)
        self._grow(tree, 2 * node + 1, rows[~left], binned, g, h, depth + 1)

    @staticmethod
    def _tree(tree: dict, x: np.ndarray) -> np.ndarray:
        out, todo = np.empty(len(x)), [(1, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            f, cut, value = tree[node]
            if f < 0:
                out[rows] = value
            else:
                right = x[rows, f] >= cut
                todo += [(2 * node, rows[~right]), (2 * node + 1, rows[right])]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for tree in self.nodes:
            z += self.rate * self._tree(tree, x)
        return 1 / (1 + np.exp(-z))
