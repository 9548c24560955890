"""Gradient-boosted regression trees for two classes, on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 64


@dataclass
class Boosted:
    """Trees of a fixed depth as arrays: an inner node's children are 2i+1 and 2i+2."""

    edges: list[np.ndarray]
    base: float
    depth: int
    features: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int64))
    cuts: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    leaves: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - len(feature)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, least: float = 2.0, pull: float = 1.0) -> Boosted:
    """Log-loss boosting with second-order leaves; least is the smallest weight of a leaf, pull its pull to 0."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([e.searchsorted(x[:, f], "left") for f, e in enumerate(edges)], 1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score = np.full(len(y), base)
    inner, ends = 2**depth - 1, 2**depth
    all_features, all_cuts, all_leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            node = at - first
            best = np.full(n, 1e-6)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                key = node * BINS + binned[:, f]
                gs = np.bincount(key, g, n * BINS).reshape(n, BINS).cumsum(1)
                hs = np.bincount(key, h, n * BINS).reshape(n, BINS).cumsum(1)
                left_g, left_h = gs[:, : len(e)], hs[:, : len(e)]
                right_g, right_h = gs[:, -1:] - left_g, hs[:, -1:] - left_h
                gain = left_g**2 / (left_h + pull) + right_g**2 / (right_h + pull) - gs[:, -1:] ** 2 / (hs[:, -1:] + pull)
                gain[(left_h < least) | (right_h < least)] = 0
                top = gain.argmax(1)
                value = gain[np.arange(n), top]
                better = value > best
                best[better] = value[better]
                feature[first : first + n][better] = f
                cut[first : first + n][better] = e[top[better]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > cut[at])
        gs, hs = np.bincount(at - inner, g, ends), np.bincount(at - inner, h, ends)
        leaf = rate * gs / (hs + pull)
        score += leaf[at - inner]
        all_features.append(feature)
        all_cuts.append(cut)
        all_leaves.append(leaf)
    return Boosted(edges, base, depth, np.array(all_features), np.array(all_cuts), np.array(all_leaves))
