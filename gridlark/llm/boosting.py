"""Gradient-boosted trees over small discrete features, fitted from counts.

Spark counts the positives and negatives of every combination of feature values over
all rows; that table is bounded by the product of the features' sizes and holds all
a tree learner needs.  The fitted trees become one Column, so scoring is part of the plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """A leaf with a value, or a split: left where the feature is at most `at`."""

    value: float = 0.0
    feature: int = -1
    at: int = 0
    left: Node | None = None
    right: Node | None = None


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float) -> Node:
    leaf = Node(value=rate * float(g.sum() / (h.sum() + 1.0)))
    if depth == 0:
        return leaf
    best, gain = None, 1e-6
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        for at in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= at
            value = g[left].sum() ** 2 / (h[left].sum() + 1.0) + g[~left].sum() ** 2 / (h[~left].sum() + 1.0) - whole
            if value > gain:
                best, gain = (f, int(at), left), value
    if best is None:
        return leaf
    f, at, left = best
    return Node(feature=f, at=at, left=_tree(x[left], g[left], h[left], depth - 1, rate), right=_tree(x[~left], g[~left], h[~left], depth - 1, rate))


def _apply(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    left = x[:, node.feature] <= node.at
    return np.where(left, _apply(node.left, x), _apply(node.right, x))


@dataclass(frozen=True)
class Forest:
    """The log odds of a row are `base` and the sum of the trees."""

    base: float
    trees: tuple[Node, ...]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((_apply(t, x) for t in self.trees), np.zeros(len(x)))

    def column(self, features: Sequence[Column]) -> Column:
        def of(node: Node) -> Column:
            return F.lit(node.value) if node.feature < 0 else F.when(features[node.feature] <= node.at, of(node.left)).otherwise(of(node.right))

        total = F.lit(self.base)
        for t in self.trees:
            total = total + of(t)
        return total


def fitted(x: np.ndarray, positive: np.ndarray, negative: np.ndarray, rounds: int = 16, depth: int = 2, rate: float = 0.4) -> Forest:
    """Boosts the logistic loss; with no rows of a kind the base odds are the smoothed share."""
    n = positive + negative
    base = float(np.log((positive.sum() + 0.5) / (negative.sum() + 0.5)))
    if not len(x) or not positive.sum() or not negative.sum():
        return Forest(base, ())
    score, trees = np.full(len(x), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = _tree(x, positive - n * p, n * p * (1 - p), depth, rate)
        trees.append(tree)
        score += _apply(tree, x)
    return Forest(base, tuple(trees))


def threshold(scores: np.ndarray, positive: np.ndarray, negative: np.ndarray, precision: float) -> float:
    """The lowest score from which held-out rows are positive with at least this precision; infinite if there is none."""
    order = np.argsort(-scores, kind="stable")
    s, p, n = scores[order], np.cumsum(positive[order]), np.cumsum(negative[order])
    last = np.r_[s[1:] != s[:-1], True] if len(s) else np.zeros(0, bool)
    good = last & (p >= precision * (p + n + 1))
    return float(s[good].min()) - 1e-9 if good.any() else float("inf")
