"""Small gradient-boosted trees and isotonic calibration on a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth: split feature and threshold per inner node."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - len(feature)]
        return total


def fit_trees(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 3, rate: float = 0.15, l2: float = 5.0) -> Trees:
    """Newton boosting of the logistic loss on quantile-binned features."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    rate_of_ones = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    margin = np.full(n, base)
    inner = 2**depth - 1
    features, cuts, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = node - first
            best = np.full(count, 1e-6)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                key = local * (BINS + 1) + binned[:, j]
                sums = [np.bincount(key, w, count * (BINS + 1)).reshape(count, BINS + 1).cumsum(axis=1) for w in (g, h)]
                left_g, left_h = (s[:, : len(e)] for s in sums)
                all_g, all_h = (s[:, -1:] for s in sums)
                gain = left_g**2 / (left_h + l2) + (all_g - left_g) ** 2 / (all_h - left_h + l2) - all_g**2 / (all_h + l2)
                at = gain.argmax(axis=1)
                value = gain[np.arange(count), at]
                better = value > best
                best = np.where(better, value, best)
                feature[first : first + count][better] = j
                cut[first : first + count][better] = e[at[better]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        leaf_of = node - inner
        leaf = -rate * np.bincount(leaf_of, g, 2**depth) / (np.bincount(leaf_of, h, 2**depth) + l2)
        margin += leaf[leaf_of]
        features.append(feature), cuts.append(cut), leaves.append(leaf)
    return Trees(base, np.array(features), np.array(cuts), np.array(leaves))


def fit_isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: knots of a rising step function, interpolated.

    Equal margins are one block from the start, so their order does not matter.
    """
    blocks: list[list[float]] = []  # sum of labels, count, first margin, last margin
    levels, level = np.unique(margin, return_inverse=True)
    for m, total, count in zip(levels, np.bincount(level, y, len(levels)), np.bincount(level, minlength=len(levels))):
        blocks.append([float(total), float(count), m, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    at = np.array([m for b in blocks for m in (b[2], b[3])])
    value = np.array([v for b in blocks for v in [b[0] / b[1]] * 2])
    return at, value
