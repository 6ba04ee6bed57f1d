"""Small gradient-boosted trees in plain Python, written out as a SQL expression.

Meant for a few thousand training rows at most: fitting is exhaustive over features and cut points.
"""

from __future__ import annotations

import math


class Boosted:
    """Trees of depth two on logistic loss, with Platt calibration of their sum."""

    def __init__(self, rows: list[list[float]], labels: list[int], trees: int = 16, rate: float = 0.4, fold: int = 4):
        learn = [i for i in range(len(rows)) if i % fold]
        check = [i for i in range(len(rows)) if i % fold == 0]
        self.trees: list = []
        mean = min(max(sum(labels[i] for i in learn) / max(1, len(learn)), 0.01), 0.99)
        self.base = math.log(mean / (1 - mean))
        total = {i: self.base for i in learn}
        for _ in range(trees):
            grad = {i: labels[i] - 1 / (1 + math.exp(-total[i])) for i in learn}
            hess = {i: max(1e-6, (g := labels[i] - grad[i]) * (1 - g)) for i in learn}
            tree = self._grow(rows, learn, grad, hess, 2, rate)
            self.trees.append(tree)
            for i in learn:
                total[i] += self._walk(tree, rows[i])
        self.slope, self.shift = 1.0, 0.0
        margins = [(self.margin(rows[i]), labels[i]) for i in check]
        for _ in range(300):  # Platt: a logistic curve through the margins of rows that were kept back
            ga = gb = 0.0
            for m, y in margins:
                d = y - 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * m + self.shift))))
                ga, gb = ga + d * m, gb + d
            n = max(1, len(margins))
            self.slope += 0.1 * ga / n
            self.shift += 0.1 * gb / n
        self.held = [(self.probability(rows[i]), labels[i]) for i in check]

    def _grow(self, rows, some, grad, hess, depth, rate):
        leaf = lambda idx: rate * sum(grad[i] for i in idx) / (sum(hess[i] for i in idx) + 1.0)
        if depth == 0 or len(some) < 8:
            return leaf(some)
        worth = lambda g, h: g * g / (h + 1.0)
        all_g, all_h = sum(grad[i] for i in some), sum(hess[i] for i in some)
        best = (1e-6, None, None)
        for f in range(len(rows[0])):
            by: dict[float, list[float]] = {}
            for i in some:
                e = by.setdefault(rows[i][f], [0.0, 0.0])
                e[0] += grad[i]
                e[1] += hess[i]
            g = h = 0.0
            values = sorted(by)
            for v, after in zip(values, values[1:], strict=False):
                g, h = g + by[v][0], h + by[v][1]
                gain = worth(g, h) + worth(all_g - g, all_h - h) - worth(all_g, all_h)
                if gain > best[0]:
                    best = (gain, f, (v + after) / 2)
        if best[1] is None:
            return leaf(some)
        _, f, at = best
        return (f, at, self._grow(rows, [i for i in some if rows[i][f] <= at], grad, hess, depth - 1, rate), self._grow(rows, [i for i in some if rows[i][f] > at], grad, hess, depth - 1, rate))

    def _walk(self, tree, row) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    def margin(self, row: list[float]) -> float:
        return self.base + sum(self._walk(t, row) for t in self.trees)

    def probability(self, row: list[float]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * self.margin(row) + self.shift))))

    def threshold(self, precision: float) -> float:
        """The least probability from which on the kept-back rows are right in `precision` of cases."""
        ordered = sorted(self.held, reverse=True)
        right, best = 0, 1.0
        for n, (p, y) in enumerate(ordered, 1):
            right += y
            if right / n >= precision and (n == len(ordered) or ordered[n][0] < p):
                best = p if n == len(ordered) else (p + ordered[n][0]) / 2
        return max(0.5, best)

    def sql(self, features: str) -> str:
        """The calibrated probability, where `features` is a SQL array of doubles."""

        def tree(t) -> str:
            if not isinstance(t, tuple):
                return f"{t:.9e}D"
            return f"CASE WHEN {features}[{t[0]}] <= {t[1]:.9e}D THEN {tree(t[2])} ELSE {tree(t[3])} END"

        margin = " + ".join([f"{self.base:.9e}D", *(f"({tree(t)})" for t in self.trees)])
        return f"1D / (1D + exp(-greatest(-30D, least(30D, {self.slope:.9e}D * ({margin}) + {self.shift:.9e}D))))"
