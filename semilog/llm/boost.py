"""Gradient-boosted trees for binary labels, in numpy; for small training sets on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """Nodes of a binary tree in breadth-first order; feature -1 marks a leaf."""

    feature: list[int]
    cut: list[float]
    value: list[float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        feature, cut = np.array(self.feature), np.array(self.cut)
        while (inner := feature[node] >= 0).any():
            f = np.where(inner, feature[node], 0)
            right = x[np.arange(len(x)), f] > cut[node]
            node = np.where(inner, 2 * node + 1 + right, node)
        return np.array(self.value)[node]


@dataclass
class Boosted:
    start: float
    rate: float
    trees: list[Tree]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.rate * sum((t.scores(x) for t in self.trees), np.zeros(len(x)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, least: float, ridge: float) -> Tree:
    size = 2 ** (depth + 1) - 1
    tree, members = Tree([-1] * size, [0.0] * size, [0.0] * size), {0: np.arange(len(x))}
    for node in range(size):
        own = members.pop(node, None)
        if own is None or not len(own):
            continue
        g, h = gradient[own], hessian[own]
        tree.value[node] = float(g.sum() / (h.sum() + ridge))
        if node >= size // 2:
            continue
        best, whole = (1e-6, -1, 0.0), g.sum() ** 2 / (h.sum() + ridge)
        for f in range(x.shape[1]):
            order = np.argsort(x[own, f], kind="stable")
            v = x[own, f][order]
            gl, hl = np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
            ok = (v[1:] > v[:-1]) & (hl >= least) & (h.sum() - hl >= least)
            if ok.any():
                gain = np.where(ok, gl**2 / (hl + ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + ridge) - whole, -1)
                if gain[i := int(gain.argmax())] > best[0]:
                    best = (float(gain[i]), f, float((v[i] + v[i + 1]) / 2))
        if best[1] >= 0:
            tree.feature[node], tree.cut[node] = best[1], best[2]
            right = x[own, best[1]] > best[2]
            members[2 * node + 1], members[2 * node + 2] = own[~right], own[right]
    return tree


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, least: float = 1.0, ridge: float = 1.0) -> Boosted:
    """Newton boosting of the logistic loss."""
    rate_of = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(rate_of / (1 - rate_of))), rate, [])
    margin = np.full(len(x), model.start)
    for _ in range(trees):
        p = sigmoid(margin)
        tree = grow(x, y - p, p * (1 - p), depth, least, ridge)
        model.trees.append(tree)
        margin += rate * tree.scores(x)
    return model


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and offset that make sigmoid(slope * margin + offset) calibrated, by Newton steps with smoothed targets."""
    n1 = y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    w = np.array([1.0, 0.0])
    a = np.stack([margin, np.ones_like(margin)], 1)
    for _ in range(steps):
        p = sigmoid(a @ w)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-6 * np.eye(2), a.T @ (target - p))
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def precise_threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least threshold from which on the share of positives among selected rows is at least ``precision``."""
    order = np.argsort(-p, kind="stable")
    share = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(share >= precision)
    return float(p[order][good[-1]]) if len(good) else 1.0
