"""Small gradient-boosted trees: fitted on the driver from a bounded labelled sample, applied as SQL expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Node:
    value: float
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, lam: float, least: int) -> Node:
    node = Node(float(-g.sum() / (h.sum() + lam)))
    if depth == 0 or len(x) < 2 * least:
        return node
    best, whole = 1e-6, g.sum() ** 2 / (h.sum() + lam)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, gs, hs = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        at = at[(at + 1 >= least) & (len(x) - at - 1 >= least)]
        if not len(at):
            continue
        gain = gs[at] ** 2 / (hs[at] + lam) + (gs[-1] - gs[at]) ** 2 / (hs[-1] - hs[at] + lam) - whole
        k = int(np.argmax(gain))
        if gain[k] > best:
            best, node.feature, node.cut = float(gain[k]), f, float((v[at[k]] + v[at[k] + 1]) / 2)
    if node.feature >= 0:
        low = x[:, node.feature] <= node.cut
        node.low = _grow(x[low], g[low], h[low], depth - 1, lam, least)
        node.high = _grow(x[~low], g[~low], h[~low], depth - 1, lam, least)
    return node


def _apply(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] <= node.cut, _apply(node.low, x), _apply(node.high, x))


@dataclass
class Boosted:
    names: list[str]
    rate: float
    trees: list[Node]
    threshold: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.rate * sum((_apply(t, x) for t in self.trees), np.zeros(len(x)))

    def column(self, features: dict[str, Column]) -> Column:
        """The margin as an expression over feature columns."""

        def walk(n: Node) -> Column:
            if n.feature < 0:
                return F.lit(self.rate * n.value)
            return F.when(features[self.names[n.feature]] <= n.cut, walk(n.low)).otherwise(walk(n.high))

        out = F.lit(0.0)
        for t in self.trees:
            out = out + walk(t)
        return out


def fit(names: list[str], x: np.ndarray, y: np.ndarray, held: np.ndarray, precision: float = 0.98, rounds: int = 30, depth: int = 3, rate: float = 0.4) -> Boosted:
    """The threshold is the lowest margin, not below even odds, that reaches the precision on the held-out rows."""
    model, margin = Boosted(names, rate, []), np.zeros(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin[~held]))
        model.trees.append(_grow(x[~held], p - y[~held], p * (1 - p), depth, 1.0, 5))
        margin = margin + rate * _apply(model.trees[-1], x)
    order = np.argsort(-margin[held], kind="stable")
    m, right = margin[held][order], np.cumsum(y[held][order]) / np.arange(1, len(order) + 1)
    ok = np.flatnonzero((right >= precision) & np.append(m[1:] < m[:-1], True))
    model.threshold = max(0.0, float(m[ok[-1]])) if len(ok) else float("inf")
    return model
