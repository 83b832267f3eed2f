"""Gradient-boosted trees in numpy: histogram splits, monotone constraints, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class FlatTrees:
    """All trees in five arrays: node n tests ``x[feature[n]] <= threshold[n]`` and goes to ``left`` or
    ``right``; a leaf points to itself and adds ``value``."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every row; a step of all rows through all levels at once."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1.0 / (1.0 + np.exp(-total))


def fit_trees(
    x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 20, ridge: float = 1.0,
    without_rows: float = 1.0,
) -> FlatTrees:
    """Boosted trees for 0/1 labels under the logistic loss. ``monotone`` has 1 (may only raise the score), -1
    (may only lower it) or 0 for each feature; a split that breaks its constraint is not taken, and the leaves
    below a constrained split stay on their side of its middle. With one label only the score is constant, and
    so it is without rows, near ``without_rows``."""
    n, k = x.shape
    mean = min(max(float(y.mean()) if n else without_rows, 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    nodes: list[list] = []
    roots: list[int] = []

    def leaf(value: float) -> int:
        nodes.append([0, np.inf, len(nodes), len(nodes), value])
        return len(nodes) - 1

    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(k)]
    coded = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(k)], axis=1) if n else np.zeros((0, k), int)
    total = np.full(n, base)

    def build(rows: np.ndarray, level: int, low: float, high: float) -> int:
        g, h = grad[rows], hess[rows]
        clip = lambda v: float(np.clip(v, low, high))
        value = clip(-g.sum() / (h.sum() + ridge))
        if level == depth or len(rows) < 2 * least:
            return leaf(rate * value)
        best = (1e-6, -1, -1, 0.0, 0.0)
        gain_of = lambda gs, hs, v: -(gs * v + 0.5 * (hs + ridge) * v * v)
        whole = gain_of(g.sum(), h.sum(), value)
        for j in range(k):
            m = len(edges[j]) + 1
            if m < 2:
                continue
            c = coded[rows, j]
            gl, hl, nl = (np.cumsum(np.bincount(c, w, m))[:-1] for w in (g, h, None))
            gr, hr, nr = g.sum() - gl, h.sum() - hl, len(rows) - nl
            vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
            gain = gain_of(gl, hl, vl) + gain_of(gr, hr, vr) - whole
            gain[(nl < least) | (nr < least) | (monotone[j] * (vr - vl) < 0)] = -np.inf
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), j, i, float(vl[i]), float(vr[i]))
        _, j, i, vl, vr = best
        if j < 0:
            return leaf(rate * value)
        at = leaf(0.0)
        middle = (vl + vr) / 2
        bound = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[int(monotone[j])]
        side = coded[rows, j] <= i
        nodes[at] = [j, float(edges[j][i]), build(rows[side], level + 1, *bound[0]), build(rows[~side], level + 1, *bound[1]), 0.0]
        return at

    if n and 0 < y.mean() < 1:
        for _ in range(trees):
            p = 1.0 / (1.0 + np.exp(-total))
            grad, hess = p - y, p * (1 - p)
            first = len(nodes)
            roots.append(build(np.arange(n), 0, -np.inf, np.inf))
            own = np.full(n, roots[-1])
            f, t, le, ri, va = (np.array(c) for c in zip(*nodes[first:]))
            for _ in range(depth):
                own = np.where(x[np.arange(n), f[own - first]] <= t[own - first], le[own - first], ri[own - first])
            total = total + va[own - first]
    columns = [np.array(c) for c in zip(*nodes)] if nodes else [np.zeros(0)] * 5
    return FlatTrees(columns[0].astype(int), columns[1], columns[2].astype(int), columns[3].astype(int), columns[4], np.array(roots, int), base, depth)
