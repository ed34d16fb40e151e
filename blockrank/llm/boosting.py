"""Gradient-boosted trees for a yes-or-no label, on binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # trees x inner nodes: rows above it go right
    value: np.ndarray  # trees x leaves
    start: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out = np.full(len(x), self.start)
        row = np.arange(len(x))
        inner = self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[row, feature[at]] > cut[at])
            out += value[at - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 2.0) -> Boosted:
    """Second-order boosting of the logistic loss; trees grow level by level, each node at its best cut."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    mean = float(np.clip((y * weight).sum() / weight.sum(), 1e-3, 1 - 1e-3))
    start = float(np.log(mean / (1 - mean)))
    z = np.full(n, start)
    inner = (1 << depth) - 1
    features, cuts, values = (np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    offset = np.arange(width)[None, :] * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g, h = weight * (y - p), np.maximum(weight * p * (1 - p), 1e-9)
        at = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, nodes = (1 << level) - 1, 1 << level
            slot = ((at - first)[:, None] * (width * bins) + offset + binned).ravel()
            size = nodes * width * bins
            left_g, left_h = (np.bincount(slot, weights=np.repeat(v, width), minlength=size).reshape(nodes, width, bins).cumsum(axis=2) for v in (g, h))
            all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
            gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for k, b in enumerate(best):
                f, cut = divmod(int(b), bins)
                features[t, first + k] = f
                if cut < len(edges[f]) and gain[k, f, cut] > 1e-6:
                    cuts[t, first + k] = edges[f][cut]
            at = 2 * at + 1 + (x[np.arange(n), features[t, at]] > cuts[t, at])
        leaf = at - inner
        values[t] = rate * np.bincount(leaf, weights=g, minlength=inner + 1) / (np.bincount(leaf, weights=h, minlength=inner + 1) + ridge)
        z += values[t][leaf]
    return Boosted(features, cuts, values, start)
