"""Tree ensembles for the many small models of grouped tasks: extremely randomised trees and second-order boosting.

Both grow from arrays of one group's rows; nothing here knows of Spark."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np


class Tree(NamedTuple):
    """Nodes as arrays; feature -1 marks a leaf. Rows whose feature is at most the cut go left."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def at(self, z: np.ndarray) -> np.ndarray:
        """The value of the leaf of each row; all rows go down a level together."""
        node, rows = np.zeros(len(z), dtype=np.int64), np.arange(len(z))
        while (inner := self.feature[node] >= 0).any():
            low = z[rows, np.maximum(self.feature[node], 0)] <= self.cut[node]
            node = np.where(inner, np.where(low, self.left[node], self.right[node]), node)
        return self.value[node]


def grow(x: np.ndarray, rows: np.ndarray, depth: int, split: Callable, leaf: Callable) -> Tree:
    """split(rows) gives (feature, cut) or None, leaf(rows) the value."""
    nodes, open_ = [], [(rows, 0, -1, 2)]
    while open_:
        own, level, parent, side = open_.pop()
        at, found = len(nodes), split(own) if level < depth else None
        if parent >= 0:
            nodes[parent][side] = at
        if found is None:
            nodes.append([-1, 0.0, 0, 0, leaf(own)])
            continue
        feature, cut = found
        nodes.append([feature, cut, 0, 0, leaf(own)])
        low = x[own, feature] <= cut
        open_ += [(own[low], level + 1, at, 2), (own[~low], level + 1, at, 3)]
    feature, cut, left, right, value = zip(*nodes)
    return Tree(np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(value))


def extra_trees(x: np.ndarray, y: np.ndarray, z: np.ndarray, trees: int = 100, depth: int = 10, least: int = 3, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Classes, and the probability of each for the rows of z: mean leaf shares under balanced class weights.

    A node draws one cut between the ends of each of sqrt(features) features that vary in it, and takes the one that
    leaves the least impurity. No bootstrap. Nodes of fewer than `least` rows are leaves."""
    rng = np.random.default_rng(seed)
    classes, code = np.unique(y, return_inverse=True)
    weight = np.eye(len(classes))[code] * (len(y) / (len(classes) * np.bincount(code)))[code][:, None]
    tried = max(1, int(np.sqrt(x.shape[1])))

    def split(rows: np.ndarray):
        if len(rows) < least or (weight[rows].sum(axis=0) > 0).sum() < 2:
            return None
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        vary = np.flatnonzero(high > low)
        if not len(vary):
            return None
        pick = rng.permutation(vary)[:tried]
        cut = rng.uniform(low[pick], high[pick])
        cut = np.where(cut >= high[pick], low[pick], cut)
        left = (x[np.ix_(rows, pick)] <= cut).T.astype(float) @ weight[rows]
        right = weight[rows].sum(axis=0) - left
        # Weighted impurity of both sides, but for a constant: sum of squares over the sum, the larger the purer.
        pure = (left**2).sum(axis=1) / left.sum(axis=1) + (right**2).sum(axis=1) / right.sum(axis=1)
        best = int(np.argmax(pure))
        return int(pick[best]), float(cut[best])

    def leaf(rows: np.ndarray) -> np.ndarray:
        total = weight[rows].sum(axis=0)
        return total / total.sum()

    everything = np.arange(len(x))
    return classes, np.mean([grow(x, everything, depth, split, leaf).at(z) for _ in range(trees)], axis=0)


def best_cut(x: np.ndarray, g: np.ndarray, h: np.ndarray, l1: float, l2: float, least: float) -> tuple[float, int, float] | None:
    """The gain, feature and cut of the split that most lowers the second-order loss; None if none lowers it.

    g and h are the rows' gradients and curvatures; each side keeps a curvature of at least `least`. All cuts
    between different values are tried: sorted columns, running sums. Ties go to the first feature and cut."""
    if len(x) < 2:
        return None
    worth = lambda a, b: np.maximum(np.abs(a) - l1, 0) ** 2 / (b + l2)
    order = np.argsort(x, axis=0, kind="stable")
    value = np.take_along_axis(x, order, axis=0)
    left_g, left_h = np.cumsum(g[order], axis=0)[:-1], np.cumsum(h[order], axis=0)[:-1]
    total_g, total_h = g.sum(), h.sum()
    gain = worth(left_g, left_h) + worth(total_g - left_g, total_h - left_h) - worth(total_g, total_h)
    gain[(value[1:] <= value[:-1]) | (left_h < least) | (total_h - left_h < least)] = -np.inf
    feature, at = np.unravel_index(int(np.argmax(gain.T)), gain.T.shape)
    if not gain[at, feature] > 1e-12:
        return None
    low, high = value[at, feature], value[at + 1, feature]
    middle = low + (high - low) / 2
    return float(gain[at, feature]), int(feature), float(low if middle >= high else middle)


def boosted(
    x: np.ndarray, y: np.ndarray, z: np.ndarray, rounds: int = 100, depth: int = 5, rate: float = 0.1, rows_share: float = 0.8, columns_share: float = 0.8, l1: float = 0.1, l2: float = 1.0, least: float = 1.0, seed: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """Classes, and the probability of each for the rows of z: gradient boosting by Newton steps on the log loss.

    Two classes have one score, more have one each under a softmax. A tree sees a share of the rows and columns."""
    rng = np.random.default_rng(seed)
    classes, code = np.unique(y, return_inverse=True)
    width = 1 if len(classes) == 2 else len(classes)
    target = code[:, None].astype(float) if width == 1 else np.eye(width)[code]
    score, asked = np.zeros((len(x), width)), np.zeros((len(z), width))

    def link(s: np.ndarray) -> np.ndarray:
        if width == 1:
            return 1 / (1 + np.exp(-s))
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    for _ in range(rounds):
        p = link(score)
        grad, curve = p - target, np.maximum((p * (1 - p)) * (1 if width == 1 else 2), 1e-16)
        for k in range(width):
            rows = np.sort(rng.permutation(len(x))[: max(1, round(rows_share * len(x)))])
            columns = np.sort(rng.permutation(x.shape[1])[: max(1, int(columns_share * x.shape[1]))])
            g, h = grad[:, k], curve[:, k]

            def split(own: np.ndarray):
                found = best_cut(x[np.ix_(own, columns)], g[own], h[own], l1, l2, least)
                return None if found is None else (int(columns[found[1]]), found[2])

            def leaf(own: np.ndarray) -> float:
                total = g[own].sum()
                return -np.sign(total) * max(abs(total) - l1, 0) / (h[own].sum() + l2)

            tree = grow(x, rows, depth, split, leaf)
            score[:, k] += rate * tree.at(x)
            asked[:, k] += rate * tree.at(z)
    p = link(asked)
    return classes, np.concatenate([1 - p, p], axis=1) if width == 1 else p
