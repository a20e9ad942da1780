"""Histogram gradient-boosted trees for two classes, flattened into arrays for numpy traversal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth: node i has children 2i+1 (value <= threshold) and 2i+2."""

    depth: int
    bias: float
    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray  # (trees, 2**depth - 1)
    leaf: np.ndarray  # (trees, 2**depth)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        first = (1 << self.depth) - 1
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - first]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 1.0) -> Trees:
    """Boost logistic loss. Splits are chosen from per-bin sums of gradients; ties take the first feature.

    Without rows, or with one class only, the trees are empty and the score is the class's prior.
    """
    n = len(y)
    prior = (y.sum() + 0.5) / (n + 1) if n else 0.5
    inner, leaves = (1 << depth) - 1, 1 << depth
    model = Trees(depth, float(np.log(prior / (1 - prior))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if n == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)]).astype(np.int64)
    logit = np.full(n, model.bias)
    made = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for d in range(depth):
            width, base = 1 << d, (1 << d) - 1
            best, pick = np.full(width, 1e-9), np.full((width, 2), -1)
            for j, b in enumerate(binned):
                key = node * bins + b
                gs = np.bincount(key, g, width * bins).reshape(width, bins)
                hs = np.bincount(key, h, width * bins).reshape(width, bins)
                gl, hl = np.cumsum(gs, 1), np.cumsum(hs, 1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < least) | (ht - hl < least)] = 0
                gain[:, len(edges[j]) :] = 0
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better] = top[better]
                pick[better] = np.stack((np.full(width, j), at), 1)[better]
            right = np.zeros(n, bool)
            for k in range(width):
                j, at = pick[k]
                if j >= 0:
                    feature[base + k], threshold[base + k] = j, edges[j][at]
                    mine = node == k
                    right[mine] = binned[j][mine] > at
            node = 2 * node + right
        gs, hs = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        leaf = -rate * gs / (hs + l2)
        logit += leaf[node]
        made.append((feature, threshold, leaf))
    model.feature, model.threshold, model.leaf = (np.stack(a) for a in zip(*made, strict=True))
    return model
