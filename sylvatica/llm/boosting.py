"""Gradient-boosted regression trees, isotonic calibration and classification trees in numpy.

Models are fitted on the driver on bounded samples and are small enough to travel with a task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """Nodes in arrays; a leaf has feature -1.  Rows with x[feature] <= threshold go left."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for column, item in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, value)):
            column.append(item)
        return len(self.value) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, threshold = np.array(self.feature), np.array(self.threshold)
        left, right, value = np.array(self.left), np.array(self.right), np.array(self.value)
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                return value[at]
            node = at[inner]
            goes_left = x[inner, feature[node]] <= threshold[node]
            at[inner] = np.where(goes_left, left[node], right[node])


def cuts(x: np.ndarray, bins: int = 64) -> list[np.ndarray]:
    """Candidate thresholds of each feature: its quantiles."""
    return [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if len(column) else np.zeros(0) for column in x.T]


def _split(x, g, h, rows, edges, least, penalty):
    """The best (gain, feature, threshold) of a node under Newton's gain."""
    best = (1e-9, -1, 0.0)
    total_g, total_h = g[rows].sum(), h[rows].sum()
    base = total_g**2 / (total_h + penalty)
    for j, edge in enumerate(edges):
        if not len(edge):
            continue
        bucket = np.searchsorted(edge, x[rows, j], side="left")
        sum_g = np.cumsum(np.bincount(bucket, g[rows], len(edge) + 1))[:-1]
        sum_h = np.cumsum(np.bincount(bucket, h[rows], len(edge) + 1))[:-1]
        count = np.cumsum(np.bincount(bucket, minlength=len(edge) + 1))[:-1]
        gain = sum_g**2 / (sum_h + penalty) + (total_g - sum_g) ** 2 / (total_h - sum_h + penalty) - base
        gain[(count < least) | (len(rows) - count < least)] = -1
        top = int(np.argmax(gain))
        if gain[top] > best[0]:
            best = (float(gain[top]), j, float(edge[top]))
    return best


def grow(x, g, h, edges, depth: int, least: int, penalty: float) -> Tree:
    """A regression tree for one Newton step on gradients ``g`` and curvatures ``h``."""
    tree = Tree()

    def build(rows: np.ndarray, level: int) -> int:
        node = tree.add(float(-g[rows].sum() / (h[rows].sum() + penalty)))
        if level < depth and len(rows) >= 2 * least:
            gain, j, threshold = _split(x, g, h, rows, edges, least, penalty)
            if j >= 0:
                goes_left = x[rows, j] <= threshold
                tree.feature[node], tree.threshold[node] = j, threshold
                tree.left[node] = build(rows[goes_left], level + 1)
                tree.right[node] = build(rows[~goes_left], level + 1)
        return node

    build(np.arange(len(x)), 0)
    return tree


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (scores, the non-decreasing frequency of label 1 at each)."""
    order = np.argsort(score, kind="stable")
    score, label = score[order], label[order]
    first, start = np.unique(score, return_index=True)
    if not len(first):
        return np.zeros(1), np.zeros(1)
    sums = np.add.reduceat(label.astype(float), start)
    counts = np.diff(np.append(start, len(score))).astype(float)
    blocks: list[list[float]] = []  # [sum, count, first x, last x]
    for x, s, c in zip(first, sums, counts, strict=True):
        blocks.append([s, c, x, x])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, c2, _, last = blocks.pop()
            blocks[-1][0] += s2
            blocks[-1][1] += c2
            blocks[-1][3] = last
    xs = np.array([v for b in blocks for v in (b[2], b[3])])
    ys = np.array([b[0] / b[1] for b in blocks for _ in (0, 1)])
    return xs, ys


@dataclass
class Boosted:
    """A fitted classifier: raw score -> isotonic frequency, in [0, 1]."""

    prior: float
    rate: float
    trees: list[Tree]
    xs: np.ndarray
    ys: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.prior + self.rate * sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return np.clip(np.interp(self.raw(x), self.xs, self.ys), 0.0, 1.0)


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, rate: float = 0.15, depth: int = 3, least: int = 8, penalty: float = 1.0, fold: np.ndarray | None = None) -> Boosted:
    """Logistic boosting.  Rows with ``fold`` true only calibrate.  One class alone gives a constant score."""
    fold = np.zeros(len(x), bool) if fold is None else fold
    if fold.all() or len(np.unique(y[~fold])) < 2 or len(np.unique(y[fold])) < 2:
        fold = np.zeros(len(x), bool)
    if not len(y) or len(np.unique(y)) < 2:
        level = float(y.mean()) if len(y) else 0.0
        return Boosted(0.0, rate, [], np.zeros(1), np.array([level]))
    fit_x, fit_y = x[~fold], y[~fold].astype(float)
    mean = fit_y.mean()
    prior = float(np.log(mean / (1 - mean)))
    edges, raw, trees = cuts(fit_x), np.full(len(fit_y), prior), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        tree = grow(fit_x, p - fit_y, p * (1 - p), edges, depth, least, penalty)
        if len(tree.value) == 1:
            break
        trees.append(tree)
        raw += rate * tree.predict(fit_x)
    model = Boosted(prior, rate, trees, np.zeros(1), np.zeros(1))
    held_x, held_y = (x[fold], y[fold]) if fold.any() else (x, y)
    model.xs, model.ys = isotonic(model.raw(held_x), held_y)
    return model


def classification_tree(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 1) -> Tree:
    """A decision tree on 0/1 labels; the squared-error gain is Gini's.  Thresholds lie between seen values."""
    edges = [(v[1:] + v[:-1]) / 2 for v in (np.unique(column) for column in x.T)]
    return grow(x, -y.astype(float), np.ones(len(y)), edges, depth, least, 1e-9)
