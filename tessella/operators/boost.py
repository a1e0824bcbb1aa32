"""Gradient-boosted regression trees over binned features: leaf by leaf, with early stopping and importances by gain.

For tables that fit in a task: a bounded sample, see ml.fit_utility.
"""

from __future__ import annotations

import heapq

import numpy as np

LEAVES, RATE, LEAST, BINS = 31, 0.05, 20, 255


def bin_cuts(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """For each feature the values after which a bin ends; a value is in the bin of the first cut that is not below it. Nulls (nan) are in bin 0."""
    out = []
    for column in x.T:
        known = np.unique(column[~np.isnan(column)])
        if len(known) > bins - 1:
            known = np.unique(np.quantile(known, np.linspace(0, 1, bins - 1), method="lower"))
        out.append(known)
    return out


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    cols = [np.where(np.isnan(c), 0, 1 + np.searchsorted(cut, c, side="left")) for c, cut in zip(x.T, cuts, strict=True)]
    return np.stack(cols, 1).astype(np.int64) if cols else np.empty((len(x), 0), np.int64)


class Tree:
    """feature (-1: a leaf), cut (bins up to it go left), left and right child, value of each node."""

    def __init__(self, bins: np.ndarray, residual: np.ndarray, gains: np.ndarray, leaves: int, least: int):
        self.feature, self.cut, self.left, self.right, self.value = [], [], [], [], []
        width = int(bins.max(initial=0)) + 1
        offset = np.arange(bins.shape[1]) * width

        def grown(rows: np.ndarray) -> int:
            for a, v in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.right, -1), (self.value, float(residual[rows].mean()))):
                a.append(v)
            return len(self.feature) - 1

        def best(rows: np.ndarray) -> tuple[float, int, int] | None:
            """Gain, feature and cut of the best split that leaves `least` rows on either side."""
            if len(rows) < 2 * least or not bins.shape[1]:
                return None
            at = (bins[rows] + offset).ravel()
            n = np.bincount(at, minlength=width * len(offset)).reshape(-1, width).cumsum(1)
            s = np.bincount(at, np.repeat(residual[rows], len(offset)), width * len(offset)).reshape(-1, width).cumsum(1)
            total, m = s[0, -1], len(rows)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = s**2 / n + (total - s) ** 2 / (m - n) - total**2 / m
            gain[(n < least) | (m - n < least)] = -1
            k = int(gain.argmax())
            return (float(gain.flat[k]), k // width, k % width) if gain.flat[k] > 1e-12 else None

        queue: list = []

        def offer(node: int, rows: np.ndarray) -> None:
            if (found := best(rows)) is not None:
                heapq.heappush(queue, (-found[0], node, found[1], found[2], rows))

        every = np.arange(len(bins))
        offer(grown(every), every)
        for _ in range(leaves - 1):
            if not queue:
                break
            loss, node, feature, cut, rows = heapq.heappop(queue)
            gains[feature] -= loss
            under = bins[rows, feature] <= cut
            self.feature[node], self.cut[node] = feature, cut
            for side, part in ((self.left, rows[under]), (self.right, rows[~under])):
                side[node] = grown(part)
                offer(side[node], part)
        self.feature, self.cut, self.left, self.right, self.value = map(np.array, (self.feature, self.cut, self.left, self.right, self.value))

    def predict(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        while len(inner := np.flatnonzero(self.feature[node] >= 0)):
            at = node[inner]
            node[inner] = np.where(bins[inner, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return self.value[node]


class Boosted:
    """A sum of trees for squared loss; with validation rows it ends where their mean absolute error has not fallen for `patience` rounds, and keeps the best round."""

    def __init__(self, x: np.ndarray, y: np.ndarray, valid: tuple[np.ndarray, np.ndarray] | None = None, rounds: int = 300, patience: int = 20, rate: float = RATE, leaves: int = LEAVES, least: int = LEAST):
        self.cuts, self.start, self.rate = bin_cuts(x), float(y.mean()) if len(y) else 0.0, rate
        self.trees: list[Tree] = []
        bins, score = binned(x, self.cuts), np.full(len(y), self.start)
        gains, kept = np.zeros(x.shape[1]), np.zeros(x.shape[1])
        seen = binned(valid[0], self.cuts) if valid else None
        held = np.full(len(valid[1]), self.start) if valid else None
        least_error, best = np.inf, 0
        for n in range(1, rounds + 1 if len(y) else 1):
            tree = Tree(bins, y - score, gains, leaves, least)
            score += rate * tree.predict(bins)
            self.trees.append(tree)
            if valid is None:
                best, kept = n, gains
                continue
            held += rate * tree.predict(seen)
            error = float(np.abs(valid[1] - held).mean())
            if error < least_error:
                least_error, best, kept = error, n, gains.copy()
            elif n - best >= patience:
                break
        self.trees, self.gains = self.trees[:best], kept

    def state(self) -> dict:
        """Plain arrays: what workers can read without a copy of the package."""
        return vars(self) | {"trees": [vars(t) for t in self.trees]}

    @staticmethod
    def revived(state: dict) -> Boosted:
        out = object.__new__(Boosted)
        out.__dict__ = dict(state, trees=[object.__new__(Tree) for _ in state["trees"]])
        for tree, arrays in zip(out.trees, state["trees"], strict=True):
            tree.__dict__ = arrays
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        bins, out = binned(x, self.cuts), np.full(len(x), self.start)
        for tree in self.trees:
            out += self.rate * tree.predict(bins)
        return out


def mean_ranks(x: np.ndarray) -> np.ndarray:
    _, at, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[at]


def rank_correlation(x: np.ndarray, y: np.ndarray) -> float | None:
    a, b = mean_ranks(x), mean_ranks(y)
    return float(np.corrcoef(a, b)[0, 1]) if len(x) > 1 and a.std() and b.std() else None
