"""Histogram gradient-boosted trees, a single decision tree and isotonic calibration in numpy.

Fitting takes a bounded sample; a fitted model is a handful of flat arrays that travel to
the executors with the task and are walked for a whole batch at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Trees as flat arrays; node 2i+1 and 2i+2 are the children of node i in each tree."""

    feature: np.ndarray  # (trees, nodes) int32, -1: leaf
    threshold: np.ndarray  # (trees, nodes) float64; left when x <= threshold
    value: np.ndarray  # (trees, nodes) float64
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = f[node]
                inner = at >= 0
                right = x[rows, np.maximum(at, 0)] > t[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            out += v[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    qs = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(c, qs, method="lower")) for c in x.T]


def _grow(binned, edges, grad, hess, depth, min_rows, l2):
    """One tree by level: gradient histograms for every open node and feature at once."""
    n, d = binned.shape
    nodes = 2 ** (depth + 1) - 1
    width = max(len(e) for e in edges) + 1
    feature, threshold, value = np.full(nodes, -1, np.int32), np.zeros(nodes), np.zeros(nodes)
    at = np.zeros(n, np.int64)
    for level in range(depth + 1):
        first, count = 2**level - 1, 2**level
        live = at >= first
        local = at[live] - first
        g, h = np.bincount(local, grad[live], count), np.bincount(local, hess[live], count)
        value[first : first + count] = -g / (h + l2)
        if level == depth:
            break
        best = np.zeros(count)
        for j in range(d):
            key = local * width + binned[live, j]
            gl = np.bincount(key, grad[live], count * width).reshape(count, width).cumsum(1)[:, :-1]
            hl = np.bincount(key, hess[live], count * width).reshape(count, width).cumsum(1)[:, :-1]
            nl = np.bincount(key, minlength=count * width).reshape(count, width).cumsum(1)
            nr = nl[:, -1:] - nl[:, :-1]
            gain = gl**2 / (hl + l2) + (g[:, None] - gl) ** 2 / (h[:, None] - hl + l2) - (g**2 / (h + l2))[:, None]
            gain[(nl[:, :-1] < min_rows) | (nr < min_rows)] = 0
            gain[:, len(edges[j]) :] = 0
            cut = gain.argmax(1)
            won = gain[np.arange(count), cut]
            better = np.flatnonzero(won > best + 1e-9)
            best[better] = won[better]
            feature[first + better] = j
            threshold[first + better] = edges[j][cut[better]]
        split = feature[at] >= 0
        split &= live
        j = feature[at[split]]
        rows = np.flatnonzero(split)
        right = np.array([0]) if not len(rows) else _bin_of(edges, j, threshold[at[split]], binned[rows, j])
        at[rows] = 2 * at[rows] + 1 + right
    return feature, threshold, value, at


def _bin_of(edges, features, cuts, bins):
    """1 where the row's bin lies right of the node's cut."""
    at = np.zeros(len(bins), np.int64)
    for j in np.unique(features):
        own = features == j
        at[own] = np.searchsorted(edges[j], cuts[own])
    return (bins > at).astype(np.int64)


def fit_boosted(x, y, trees=80, depth=4, rate=0.15, bins=64, min_rows=10, l2=1.0) -> Forest:
    """Logistic boosting. With one class only, or no rows, the forest is its base rate."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    p = np.clip((y.sum() + 0.5) / (len(y) + 1), 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    nodes = 2 ** (depth + 1) - 1
    if len(y) < 2 * min_rows or y.min() == y.max():
        return Forest(np.full((0, nodes), -1, np.int32), np.zeros((0, nodes)), np.zeros((0, nodes)), base, depth)
    edges = _edges(x, bins)
    binned = np.column_stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)])
    margin, grown = np.full(len(y), base), []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        f, t, v, leaf = _grow(binned, edges, prob - y, np.maximum(prob * (1 - prob), 1e-6), depth, min_rows, l2)
        v = v * rate
        margin += v[leaf]
        grown.append((f, t, v))
    return Forest(*[np.array(a) for a in zip(*grown, strict=True)], base, depth)


def fit_tree(x, y, depth=6, min_rows=1) -> Forest:
    """One least-squares classification tree: the value of a leaf is its share of label 1."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    edges = [np.unique(c)[:-1] if len(np.unique(c)) > 1 else np.unique(c) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)])
    f, t, v, _ = _grow(binned, edges, -y, np.ones(len(y)), depth, min_rows, 1e-9)
    return Forest(f[None], t[None], v[None], 0.0, depth)


@dataclass(frozen=True)
class Isotonic:
    """A nondecreasing step map, linear between the block centres."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y) if len(self.x) else score


def fit_isotonic(score, label) -> Isotonic:
    """Pool adjacent violators; equal scores are pooled first."""
    if not len(score):
        return Isotonic(np.array([]), np.array([]))
    xs, inverse = np.unique(score, return_inverse=True)
    n = np.bincount(inverse).astype(float)
    mean = np.bincount(inverse, label) / n
    blocks: list[list[float]] = []  # weight, mean, weighted score
    for x, w, m in zip(xs, n, mean, strict=True):
        blocks.append([w, m, x * w])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, m2, s2 = blocks.pop()
            w1, m1, s1 = blocks[-1]
            blocks[-1] = [w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), s1 + s2]
    return Isotonic(np.array([b[2] / b[0] for b in blocks]), np.array([b[1] for b in blocks]))
