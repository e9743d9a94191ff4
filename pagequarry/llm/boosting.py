"""Gradient-boosted trees over small integer features, fitted to a contingency table and scored as SQL expressions.

The distributed part is the table: one row per distinct feature vector with the number of rows and of positives, summed over
all data by Spark. Its size is bounded by the features' ranges, not by the data, so the trees are fitted on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Tree = tuple  # (feature, cut, left, right) or (value,)


@dataclass(frozen=True)
class Boosted:
    features: tuple[str, ...]
    bias: float
    trees: tuple[Tree, ...]

    def column(self, row: Column) -> Column:
        """The probability for a struct column that has the features as fields."""
        score = F.lit(self.bias)
        for tree in self.trees:
            score = score + self._node(tree, row)
        return 1 / (1 + F.exp(-score))

    def _node(self, tree: Tree, row: Column) -> Column:
        if len(tree) == 1:
            return F.lit(tree[0])
        at, cut, left, right = tree
        return F.when(row[self.features[at]] <= cut, self._node(left, row)).otherwise(self._node(right, row))

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.bias)
        for tree in self.trees:
            score += _apply(tree, x)
        return 1 / (1 + np.exp(-score))


def _apply(tree: Tree, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    at, cut, left, right = tree
    return np.where(x[:, at] <= cut, _apply(left, x), _apply(right, x))


def fit(features: tuple[str, ...], x: np.ndarray, n: np.ndarray, positives: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> Boosted:
    """Newton boosting of the logistic loss; row i stands for n[i] rows, positives[i] of which are positive.

    An empty table or one without positives gives a constant near 0.
    """
    n, positives = n.astype(float), positives.astype(float)
    share = (positives.sum() + 0.5) / (n.sum() + 1.0) if positives.sum() else 1e-6
    bias = float(np.log(share / (1 - share)))
    score, trees = np.full(len(x), bias), []
    for _ in range(rounds if positives.sum() else 0):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, positives - n * p, n * p * (1 - p), depth, ridge, rate)
        trees.append(tree)
        score += _apply(tree, x)
    return Boosted(tuple(features), bias, tuple(trees))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, ridge: float, rate: float) -> Tree:
    best, gain = None, 1e-6
    if depth:
        whole = g.sum() ** 2 / (h.sum() + ridge)
        for at in range(x.shape[1]):
            for cut in np.unique(x[:, at])[:-1]:
                low = x[:, at] <= cut
                new = g[low].sum() ** 2 / (h[low].sum() + ridge) + g[~low].sum() ** 2 / (h[~low].sum() + ridge) - whole
                if new > gain:
                    best, gain = (at, int(cut), low), new
    if best is None:
        return (float(rate * g.sum() / (h.sum() + ridge)),)
    at, cut, low = best
    return at, cut, _grow(x[low], g[low], h[low], depth - 1, ridge, rate), _grow(x[~low], g[~low], h[~low], depth - 1, ridge, rate)
