"""Gradient-boosted trees for two classes, on histograms: complete trees of a fixed depth in flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """feature, threshold: (trees x inner nodes); leaf: (trees x leaves); a row goes right if its value is above the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            while at.size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - inner] if at.size else 0.0
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 2.0, least: float = 8.0) -> Forest:
    """Newton boosting of the log loss. Splits are at quantiles of each feature."""
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    margin, inner = np.full(n, base), 2**depth - 1
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = at - first
            best = np.full(width, 1e-6)
            chosen, cut = np.zeros(width, np.int64), np.full(width, bins + 1)
            gs, hs = np.bincount(local, g, width), np.bincount(local, h, width)
            own = gs**2 / (hs + l2)
            for j in range(d):
                if not len(cuts[j]):
                    continue
                key = local * (bins + 1) + binned[:, j]
                gl = np.bincount(key, g, width * (bins + 1)).reshape(width, -1).cumsum(1)[:, :-1]
                hl = np.bincount(key, h, width * (bins + 1)).reshape(width, -1).cumsum(1)[:, :-1]
                gr, hr = gs[:, None] - gl, hs[:, None] - hl
                gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - own[:, None]
                gain[(hl < least * 0.05) | (hr < least * 0.05)] = -1
                gain[:, len(cuts[j]) :] = -1
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                better = top > best
                best[better], chosen[better], cut[better] = top[better], j, k[better]
            for w in range(width):
                if cut[w] <= bins:
                    feature[t, first + w], threshold[t, first + w] = chosen[w], cuts[chosen[w]][cut[w]]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > threshold[t, at])
        local = at - inner
        leaf[t] = rate * np.bincount(local, g, inner + 1) / (np.bincount(local, h, inner + 1) + l2)
        margin += leaf[t][local]
    return Forest(feature, threshold, leaf, base)
