"""Gradient-boosted trees for two classes, trained on a small table in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Complete trees of one depth: split features, thresholds and leaf values."""

    depth: int
    base: float = 0.0
    features: list[np.ndarray] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.features, self.cuts, self.leaves):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += leaf[at - (2**self.depth - 1)]
        return out


def train(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 4, rate: float = 0.25, bins: int = 32, l2: float = 1.0) -> Boosted:
    """Logistic loss, second-order gains over binned features."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)], 1)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    model = Boosted(depth, float(np.log(share / (1 - share))))
    score = np.full(n, model.base)
    inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        feature, cut, split = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), np.full(inner, bins)
        at = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = at - first
            best = np.zeros(width)
            for j in range(d):
                if not len(edges[j]):
                    continue
                key = local * bins + binned[:, j]
                gs = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(1)
                hs = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(1)
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < 1) | (ht - hl < 1)] = 0
                gain = gain[:, : len(edges[j])]
                at_best = gain.argmax(1)
                value = gain[np.arange(width), at_best]
                better = np.flatnonzero(value > best + 1e-9)
                best[better] = value[better]
                feature[first + better], split[first + better] = j, at_best[better]
                cut[first + better] = edges[j][at_best[better]]
            at = 2 * at + 1 + (binned[np.arange(n), feature[at]] > split[at])
        leaf = at - inner
        gs, hs = np.bincount(leaf, g, 2**depth), np.bincount(leaf, h, 2**depth)
        values = rate * gs / (hs + l2)
        score += values[leaf]
        model.features.append(feature)
        model.cuts.append(cut)
        model.leaves.append(values)
    return model
