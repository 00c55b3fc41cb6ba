"""Gradient boosting on counted cells: exact training over any number of rows whose features are binned.

Rows are first counted by their feature values in Spark; the number of distinct cells is bounded by the product of
the bin counts.  Small regression trees are then fitted to the logistic loss of the counted cells, and turned into
``CASE`` expressions for scoring.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """Cells whose ``feature`` is at most ``at`` go low; a leaf has no feature."""

    value: float = 0.0
    feature: int = -1
    at: int = 0
    low: Node | None = None
    high: Node | None = None


def _fit(cells: list, grad: list[float], hess: list[float], rows: list[int], depth: int, rate: float) -> Node:
    g, h = sum(grad[i] for i in rows), sum(hess[i] for i in rows)
    leaf = Node(value=rate * g / (h + 1.0))
    if depth == 0:
        return leaf
    best, chosen = 1e-6, None
    for f in range(len(cells[0][0])):
        sums: dict[int, list[float]] = {}
        for i in rows:
            s = sums.setdefault(cells[i][0][f], [0.0, 0.0])
            s[0] += grad[i]
            s[1] += hess[i]
        gl = hl = 0.0
        for v in sorted(sums)[:-1]:
            gl, hl = gl + sums[v][0], hl + sums[v][1]
            gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
            if gain > best:
                best, chosen = gain, (f, v)
    if chosen is None:
        return leaf
    f, v = chosen
    low, high = [i for i in rows if cells[i][0][f] <= v], [i for i in rows if cells[i][0][f] > v]
    return Node(0.0, f, v, _fit(cells, grad, hess, low, depth - 1, rate), _fit(cells, grad, hess, high, depth - 1, rate))


def value_at(node: Node, x: tuple[int, ...]) -> float:
    while node.feature >= 0:
        node = node.low if x[node.feature] <= node.at else node.high
    return node.value


def total(prior: float, trees: list[Node], x: tuple[int, ...]) -> float:
    """Log-odds of one row of features."""
    return prior + sum(value_at(t, x) for t in trees)


def fit(cells: list[tuple[tuple[int, ...], float, float]], trees: int = 30, depth: int = 3, rate: float = 0.3) -> tuple[float, list[Node]]:
    """Prior log-odds and trees from cells (features, rows, positive rows)."""
    n, pos = sum(c[1] for c in cells), sum(c[2] for c in cells)
    prior = math.log((pos + 0.5) / (n - pos + 0.5))
    score, out = [prior] * len(cells), []
    for _ in range(trees if 0 < pos < n else 0):
        p = [1 / (1 + math.exp(-s)) for s in score]
        tree = _fit(cells, [c[2] - c[1] * q for c, q in zip(cells, p, strict=True)], [c[1] * q * (1 - q) for c, q in zip(cells, p, strict=True)], list(range(len(cells))), depth, rate)
        out.append(tree)
        score = [max(-30.0, min(30.0, s + value_at(tree, c[0]))) for s, c in zip(score, cells, strict=True)]
    return prior, out


def expression(node: Node, features: list[Column]) -> Column:
    if node.feature < 0:
        return F.lit(node.value)
    return F.when(features[node.feature] <= node.at, expression(node.low, features)).otherwise(expression(node.high, features))


def score(prior: float, trees: list[Node], features: list[Column]) -> Column:
    """Log-odds of the features."""
    total = F.lit(prior)
    for tree in trees:
        total = total + expression(tree, features)
    return total
