"""Regression trees on ordinal features: boosted with monotone bounds, or in forests."""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

from premia.schema import CATEGORICAL, FIELD_ORDER

MOST_BINS = 255
CATEGORIES = np.array([n in CATEGORICAL for n in FIELD_ORDER])


@dataclass
class Tree:
    """Nodes as parallel lists. A row goes left where its value is at most `at`, or its level is among `levels` (bits)."""

    feature: list[int] = field(default_factory=list)
    at: list[float] = field(default_factory=list)
    levels: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def leaf(self, value: float) -> int:
        for column, x in ((self.feature, -1), (self.at, 0.0), (self.levels, 0), (self.left, 0), (self.right, 0), (self.value, value)):
            column.append(x)
        return len(self.value) - 1

    def predict(self, rows: np.ndarray) -> np.ndarray:
        feature, at, levels = np.array(self.feature), np.array(self.at), np.array(self.levels)
        left, right, value = np.array(self.left), np.array(self.right), np.array(self.value)
        node = np.zeros(len(rows), int)
        moving = np.flatnonzero(feature[node] >= 0)
        while len(moving):
            own = node[moving]
            x = rows[moving, feature[own]]
            down = np.where(CATEGORIES[feature[own]], (levels[own] >> x.astype(int)) & 1 == 1, x <= at[own])
            node[moving] = np.where(down, left[own], right[own])
            moving = moving[feature[node[moving]] >= 0]
        return value[node]

    def predict_one(self, row: list[float]) -> float:
        node = 0
        while (f := self.feature[node]) >= 0:
            down = self.levels[node] >> int(row[f]) & 1 if CATEGORIES[f] else row[f] <= self.at[node]
            node = self.left[node] if down else self.right[node]
        return self.value[node]


def bin_edges(rows: np.ndarray) -> list[np.ndarray]:
    """Upper bounds of each numeric feature's bins; a category's level is its bin."""
    edges = []
    for f in range(rows.shape[1]):
        seen = np.unique(rows[:, f])
        cuts = (seen[:-1] + seen[1:]) / 2 if len(seen) <= MOST_BINS else np.unique(np.quantile(rows[:, f], np.linspace(0, 1, MOST_BINS + 1)[1:-1]))
        edges.append(np.arange(int(seen.max())) + 0.5 if CATEGORIES[f] else cuts)
    return edges


@dataclass
class _Split:
    gain: float
    feature: int
    at: float
    levels: int
    left: np.ndarray
    right: np.ndarray
    values: tuple[float, float]


def _find(binned: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, rows: np.ndarray, bounds: tuple[float, float], signs: np.ndarray, least: int, l2: float) -> _Split | None:
    """The best split of a leaf's rows under squared loss (each row has unit hessian), or none."""
    total, count = grad[rows].sum(), len(rows)
    whole = total**2 / (count + l2)
    best: tuple | None = None
    for f in range(binned.shape[1]):
        bins = binned[rows, f]
        size = len(edges[f]) + 1
        sums, counts = np.bincount(bins, grad[rows], size), np.bincount(bins, minlength=size)
        order = np.argsort(sums / (counts + l2 + 1e-9), kind="stable") if CATEGORIES[f] else np.arange(size)
        s, n = sums[order].cumsum()[:-1], counts[order].cumsum()[:-1]
        ok = (n >= least) & (count - n >= least)
        if not ok.any():
            continue
        down, up = (np.clip(-x / (k + l2 + 1e-12), *bounds) for x, k in ((s, n), (total - s, count - n)))
        if signs[f]:
            ok &= signs[f] * (up - down) >= 0
        gain = np.where(ok, -(2 * s * down + (n + l2) * down**2) - (2 * (total - s) * up + (count - n + l2) * up**2) - whole, -np.inf)
        k = int(gain.argmax())
        if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
            best = (float(gain[k]), f, k, order, (float(down[k]), float(up[k])))
    if best is None:
        return None
    gain, f, k, order, values = best
    if CATEGORIES[f]:
        levels = sum(1 << int(b) for b in order[: k + 1])
        inside = (levels >> binned[rows, f]) & 1 == 1
        return _Split(gain, f, 0.0, levels, rows[inside], rows[~inside], values)
    inside = binned[rows, f] <= k
    return _Split(gain, f, float(edges[f][k]), 0, rows[inside], rows[~inside], values)


def grow(binned: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, signs: np.ndarray, leaves: int, least: int, l2: float, rate: float) -> Tree:
    """A tree grown best leaf first. Children of a monotone split are bounded by the middle of their values."""
    tree, rows = Tree(), np.arange(len(grad))
    tree.leaf(float(-grad.sum() / (len(grad) + l2)) * rate)
    queue: list[tuple[float, int, int, _Split, tuple[float, float]]] = []

    def offer(node: int, own: np.ndarray, bounds: tuple[float, float]) -> None:
        if split := _find(binned, edges, grad, own, bounds, signs, least, l2):
            heapq.heappush(queue, (-split.gain, node, len(queue), split, bounds))

    offer(0, rows, (-np.inf, np.inf))
    while queue and (len(tree.value) + 1) // 2 < leaves:
        _, node, _, split, (low, high) = heapq.heappop(queue)
        down, up = split.values
        tree.feature[node], tree.at[node], tree.levels[node] = split.feature, split.at, split.levels
        tree.left[node], tree.right[node] = tree.leaf(down * rate), tree.leaf(up * rate)
        sign, middle = signs[split.feature], (down + up) / 2
        offer(tree.left[node], split.left, (low, min(high, middle)) if sign > 0 else (max(low, middle), high) if sign < 0 else (low, high))
        offer(tree.right[node], split.right, (max(low, middle), high) if sign > 0 else (low, min(high, middle)) if sign < 0 else (low, high))
    return tree


def random_tree(rows: np.ndarray, targets: np.ndarray, rng: np.random.Generator, share: float, least: int, depth: int | None, drawn: bool) -> Tree:
    """A tree whose splits look at a share of the features; thresholds are drawn at random or, if not `drawn`, the best of 16."""
    tree = Tree()
    width = max(1, round(share * rows.shape[1]))

    def build(own: np.ndarray, level: int) -> int:
        y = targets[own]
        node = tree.leaf(float(y.mean()))
        if len(own) < 2 * least or (depth is not None and level >= depth) or np.ptp(y) == 0:
            return node
        best: tuple[float, int, float, int, np.ndarray] | None = None
        for f in rng.permutation(rows.shape[1])[:width]:
            x = rows[own, f]
            low, high = x.min(), x.max()
            if low == high:
                continue
            for _ in range(1 if drawn else 16):
                if CATEGORIES[f]:
                    levels = int(rng.integers(1, 1 << int(high) + 1))
                    at, inside = 0.0, (levels >> x.astype(int)) & 1 == 1
                else:
                    at, levels = float(rng.uniform(low, high)), 0
                    inside = x <= at
                n = int(inside.sum())
                if n < least or len(own) - n < least:
                    continue
                gain = y[inside].sum() ** 2 / n + y[~inside].sum() ** 2 / (len(own) - n)
                if best is None or gain > best[0]:
                    best = (gain, int(f), at, levels, inside)
        if best is None:
            return node
        _, tree.feature[node], tree.at[node], tree.levels[node], inside = best
        tree.left[node] = build(own[inside], level + 1)
        tree.right[node] = build(own[~inside], level + 1)
        return node

    build(np.arange(len(targets)), 0)
    return tree
