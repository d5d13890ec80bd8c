"""Gradient-boosted trees for a binary label, on binned features, small enough to train beside a query and to broadcast."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Complete trees of one depth: feature and cut of every inner node, value of every leaf."""

    base: float
    feature: np.ndarray  # trees x (2 ** depth - 1)
    cut: np.ndarray
    value: np.ndarray  # trees x 2 ** depth

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 4, rate: float = 0.3, bins: int = 32, l2: float = 1.0, least: float = 2.0) -> Forest:
    """Second-order boosting of the logistic loss. ``least``: sum of hessians that a leaf needs."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T, strict=True)], axis=1)
    rate_y = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate_y / (1 - rate_y)))
    raw = np.full(len(y), base)
    inner, features = 2**depth - 1, x.shape[1]
    offsets = np.arange(features) * bins
    feature, cut, value = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        at = np.zeros(len(y), np.int64)
        fs, cs = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            if len(rows):
                spots = (binned[rows] + offsets).ravel()
                gs, hs = (np.bincount(spots, np.repeat(v[rows], features), features * bins).reshape(features, bins).cumsum(1) for v in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain[(hs < least) | (ht - hs < least)] = 0
                f, b = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[f, b] > 1e-6 and b < len(cuts[f]):
                    fs[node], cs[node] = f, cuts[f][b]
                at[rows] = 2 * node + 1 + (x[rows, fs[node]] > cs[node])
        leaf = at - inner
        v = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        raw += v[leaf]
        feature.append(fs), cut.append(cs), value.append(v)
    return Forest(base, np.array(feature), np.array(cut), np.array(value))
