"""Gradient boosted trees over a small grid of features, applied as a SQL expression.

Features are small whole numbers, so all rows of a corpus fall into a bounded number of
cells. The trees are fitted on the cells with their counts of either label: that is the
whole data, not a sample, and its size is bounded by the grid.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import exp, log


@dataclass(frozen=True)
class Cell:
    values: tuple[int, ...]
    positive: float
    negative: float

    @property
    def total(self) -> float:
        return self.positive + self.negative


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    feature: int
    at_most: int
    low: Leaf | Split
    high: Leaf | Split


def _score(gradient: float, weight: float) -> float:
    return gradient * gradient / (weight + 1.0)


def _grow(rows: list[tuple[Cell, float, float]], depth: int, rate: float) -> Leaf | Split:
    """A tree on (cell, gradient, curvature) rows."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best = None
    if depth:
        for f in range(len(rows[0][0].values)):
            sums: dict[int, list[float]] = {}
            for cell, dg, dh in rows:
                slot = sums.setdefault(cell.values[f], [0.0, 0.0])
                slot[0] += dg
                slot[1] += dh
            left_g = left_h = 0.0
            for v in sorted(sums)[:-1]:
                left_g += sums[v][0]
                left_h += sums[v][1]
                gain = _score(left_g, left_h) + _score(g - left_g, h - left_h) - _score(g, h)
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, f, v)
    if best is None or best[0] <= 1e-9:
        return Leaf(rate * g / (h + 1.0))
    _, f, v = best
    low = [r for r in rows if r[0].values[f] <= v]
    high = [r for r in rows if r[0].values[f] > v]
    return Split(f, v, _grow(low, depth - 1, rate), _grow(high, depth - 1, rate))


def _value(tree: Leaf | Split, values: Sequence[int]) -> float:
    while isinstance(tree, Split):
        tree = tree.low if values[tree.feature] <= tree.at_most else tree.high
    return tree.value


def _tree_sql(tree: Leaf | Split, names: Sequence[str]) -> str:
    if isinstance(tree, Leaf):
        return f"{tree.value!r}D"
    low, high = _tree_sql(tree.low, names), _tree_sql(tree.high, names)
    return f"IF({names[tree.feature]} <= {tree.at_most}, {low}, {high})"


@dataclass(frozen=True)
class Boosted:
    base: float
    trees: tuple[Leaf | Split, ...]

    def margin(self, values: Sequence[int]) -> float:
        return self.base + sum(_value(t, values) for t in self.trees)

    def sql(self, names: Sequence[str]) -> str:
        """The margin as a SQL expression over the named features."""
        return " + ".join([f"{self.base!r}D", *[_tree_sql(t, names) for t in self.trees]])


def fit(cells: Sequence[Cell], rounds: int = 20, depth: int = 3, rate: float = 0.4) -> Boosted:
    """Boosted trees for the log odds of the positive label."""
    cells = sorted(cells, key=lambda c: c.values)
    positive, negative = sum(c.positive for c in cells), sum(c.negative for c in cells)
    base = log((positive + 1) / (negative + 1))
    margin = {c.values: base for c in cells}
    trees: list[Leaf | Split] = []
    for _ in range(rounds if positive and negative else 0):
        rows = []
        for c in cells:
            p = 1 / (1 + exp(-max(-30.0, min(30.0, margin[c.values]))))
            rows.append((c, c.positive - p * c.total, p * (1 - p) * c.total))
        tree = _grow(rows, depth, rate)
        trees.append(tree)
        for c in cells:
            margin[c.values] += _value(tree, c.values)
    return Boosted(base, tuple(trees))


def threshold(model: Boosted, cells: Sequence[Cell], precision: float) -> float | None:
    """The lowest margin at and above which the share of positives is at least ``precision``.

    Counts are smoothed by one negative, so a few chance hits don't open the gate. None
    if no margin reaches it.
    """
    ranked = sorted(((model.margin(c.values), c) for c in cells), key=lambda x: -x[0])
    positive = total = 0.0
    best = None
    for i, (m, c) in enumerate(ranked):
        positive += c.positive
        total += c.total
        last = i + 1 == len(ranked) or ranked[i + 1][0] < m
        if last and positive and positive / (total + 1) >= precision:
            best = m
    return best
