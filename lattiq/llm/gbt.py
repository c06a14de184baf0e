"""Boosted trees on a bounded sample, and isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np


class Trees:
    """Gradient boosting of the logistic loss with depth-limited trees over binned features."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 2.0, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        self.edges = [self._edges(c) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        margin, self.trees = np.full(len(y), self.base), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree, leaf = self._grow(binned, p - y, p * (1 - p))
            self.trees.append(tree)
            margin += leaf
        return self

    def _edges(self, column: np.ndarray) -> np.ndarray:
        """Thresholds between the quantiles of the distinct values: rare values get some as well."""
        values = np.unique(column)
        if len(values) > self.bins:
            values = np.unique(np.concatenate([np.quantile(column, np.linspace(0, 1, self.bins // 2)), np.quantile(values, np.linspace(0, 1, self.bins // 2))]))
        return (values[1:] + values[:-1]) / 2

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray):
        feature, threshold, value = [], [], []
        leaf = np.zeros(len(g))

        def node(rows: np.ndarray, depth: int) -> int:
            me = len(feature)
            feature.append(-1), threshold.append(0.0), value.append(0.0)
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-6, -1, 0)
            for f in range(binned.shape[1]) if depth < self.depth else ():
                n = len(self.edges[f]) + 1
                if n < 2:
                    continue
                gl = np.cumsum(np.bincount(binned[rows, f], g[rows], n))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, f], h[rows], n))[:-1]
                gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
                gain[(hl < self.least * 0.1) | (hs - hl < self.least * 0.1)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
            _, f, k = best
            if f < 0:
                value[me] = -self.rate * gs / (hs + self.ridge)
                leaf[rows] = value[me]
                return me
            feature[me], threshold[me] = f, float(self.edges[f][k])
            go = binned[rows, f] <= k
            left, right = node(rows[go], depth + 1), node(rows[~go], depth + 1)
            value[me] = (left, right)
            return me

        node(np.arange(len(g)), 0)
        return (feature, threshold, value), leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, threshold, value in self.trees:
            todo = [(0, np.arange(len(x)))]
            while todo:
                at, rows = todo.pop()
                if feature[at] < 0:
                    out[rows] += value[at]
                elif len(rows):
                    go = x[rows, feature[at]] <= threshold[at]
                    todo += [(value[at][0], rows[go]), (value[at][1], rows[~go])]
        return out


class Isotonic:
    """Pool adjacent violators; between the pools' means the curve is linear."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        pools: list[list[float]] = []  # sum of labels, weight, sum of scores
        for s, t in zip(score[order], y[order], strict=True):
            pools.append([float(t), 1.0, float(s)])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                a = pools.pop()
                pools[-1] = [p + q for p, q in zip(pools[-1], a, strict=True)]
        self.x = np.array([p[2] / p[1] for p in pools])
        self.y = np.array([p[0] / p[1] for p in pools])
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(score, self.x, self.y), 0, 1)
