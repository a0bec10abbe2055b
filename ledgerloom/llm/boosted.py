"""Histogram gradient-boosted trees for a 0/1 target, kept as flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Complete binary trees, one row each: node ``i`` has children ``2i + 1`` and ``2i + 2``.

    A row goes right where ``x[feature] > threshold``; unsplit nodes send it left.
    """

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of 1 for each row of ``x``."""
        trees = np.arange(len(self.leaf))[None, :]
        rows = np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.leaf)), np.int64)
        for _ in range(int(np.log2(self.leaf.shape[1]))):
            right = x[rows, self.feature[trees, node]] > self.threshold[trees, node]
            node = 2 * node + 1 + right
        raw = self.start + self.leaf[trees, node - self.feature.shape[1]].sum(axis=1)
        return 1 / (1 + np.exp(-raw))


def grow(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = 150,
    depth: int = 4,
    rate: float = 0.1,
    bins: int = 64,
    least: float = 20.0,
    ridge: float = 1.0,
) -> Forest:
    """Fit by second-order boosting of the logistic loss over binned columns.

    Columns are cut at quantiles into ``bins`` bins; a split leaves at least ``least``
    rows on either side. One class only, or no rows, gives a constant score.
    """
    rate_of_ones = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    start = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    inner, leaves, width = 2**depth - 1, 2**depth, x.shape[1]
    feature = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    if len(y) and 0 < y.mean() < 1:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
        offset = np.arange(width) * bins
        raw = np.full(len(y), start)
        for t in range(trees):
            p = 1 / (1 + np.exp(-raw))
            slope, bend = p - y, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for level in range(depth):
                first, count = 2**level - 1, 2**level
                cell = ((node - first)[:, None] * width * bins + offset + binned).ravel()
                shape = (count, width, bins)
                totals = [
                    np.bincount(cell, None if w is None else np.repeat(w, width), count * width * bins).reshape(shape)
                    for w in (slope, bend, None)
                ]
                (gl, hl, nl), (g, h, n) = [c.cumsum(axis=2) for c in totals], [c.sum(axis=2, keepdims=True) for c in totals]
                gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                gain[(nl < least) | (n - nl < least)] = 0
                flat = gain.reshape(count, -1)
                best = flat.argmax(axis=1)
                for k in np.flatnonzero(flat[np.arange(count), best] > 1e-9):
                    f, b = divmod(int(best[k]), bins)
                    feature[t, first + k] = f
                    # The last bin of a column has no upper cut; no gain there.
                    threshold[t, first + k] = cuts[f][b] if b < len(cuts[f]) else np.inf
                right = x[np.arange(len(y)), feature[t, node]] > threshold[t, node]
                node = 2 * node + 1 + right
            node -= inner
            down, up = np.bincount(node, slope, leaves), np.bincount(node, bend, leaves)
            leaf[t] = -rate * down / (up + ridge)
            raw += leaf[t][node]
    return Forest(feature, threshold, leaf, start)
