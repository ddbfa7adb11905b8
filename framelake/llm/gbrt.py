"""Gradient-boosted regression trees on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 48


@dataclass
class Model:
    """Trees of one depth as arrays: feature and threshold of each inner node, value of each leaf."""

    base: float
    features: np.ndarray  # (trees, 2^depth - 1)
    thresholds: np.ndarray  # (trees, 2^depth - 1); a row goes right where its feature is greater
    leaves: np.ndarray  # (trees, 2^depth)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        inner = self.features.shape[1]
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 160, depth: int = 4, rate: float = 0.08, least: float = 8.0, ridge: float = 2.0, rows: float = 0.7, seed: int = 1) -> Model:
    """Least-squares boosting; each tree sees a seeded ``rows`` share of the rows.

    ``least`` is the smallest weight of a leaf and ``ridge`` shrinks leaf values, so single labels that are
    wrong move little. A constant target or a single row gives trees of zeros.
    """
    n, k = x.shape
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(k)]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    base = float(np.average(y, weights=weight))
    score = np.full(n, base)
    inner = 2**depth - 1
    features, thresholds, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, 2**depth))
    flat = binned + np.arange(k) * BINS
    for t in range(trees):
        used = np.flatnonzero(rng.random(n) < rows) if n > 1 else np.arange(n)
        residual = (y - score) * weight
        node = np.zeros(n, dtype=np.int64)
        g = w = np.zeros((0, k, BINS))
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            g, w = _histograms(node[used] - first, flat[used], residual[used], weight[used], width, g, w)
            below, held = g.cumsum(axis=2), w.cumsum(axis=2)
            gl, wl, gt, wt = below[:, :, :-1], held[:, :, :-1], below[:, :, -1:], held[:, :, -1:]
            gain = gl**2 / (wl + ridge) + (gt - gl) ** 2 / (wt - wl + ridge) - gt**2 / (wt + ridge)
            gain[(wl < least) | (wt - wl < least)] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            for i in range(width):
                j, b = divmod(int(best[i]), BINS - 1)
                if gain[i, j, b] > 1e-9 and b < len(cuts[j]):
                    features[t, first + i], thresholds[t, first + i] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), features[t, node]] > thresholds[t, node])
        leaf = node - inner
        pull, mass = np.bincount(leaf[used], residual[used], 2**depth), np.bincount(leaf[used], weight[used], 2**depth)
        leaves[t] = rate * pull / (mass + ridge)
        score += leaves[t][leaf]
    return Model(base, features, thresholds, leaves)


def _histograms(node: np.ndarray, flat: np.ndarray, residual: np.ndarray, weight: np.ndarray, width: int, parent_g: np.ndarray, parent_w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of residuals and weights by node, feature and bin; of two sisters the larger one is its parent less the smaller."""
    k = flat.shape[1]
    rows = np.bincount(node, minlength=width)
    small = np.ones(1, bool) if width == 1 else np.repeat(rows[::2] <= rows[1::2], 2) ^ (np.arange(width) % 2 == 1)
    own = np.flatnonzero(small[node])
    at = (node[own][:, None] * (k * BINS) + flat[own]).ravel()
    size = width * k * BINS
    g, w = (np.bincount(at, np.repeat(v[own], k), size).reshape(width, k, BINS) for v in (residual, weight))
    if width > 1:
        other = np.flatnonzero(~small)
        g[other], w[other] = parent_g[other // 2] - g[other ^ 1], parent_w[other // 2] - w[other ^ 1]
    return g, w


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit of y on x (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x[order], y[order], weight[order], strict=True):
        blocks.append([yi, wi, xi, xi])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            w = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / w, w, a[2], b[3]])
    if not blocks:  # nothing to calibrate by: grades stay as they are
        return np.array([0.0, 100.0]), np.array([0.0, 100.0])
    knots = np.array([(edge, b[0]) for b in blocks for edge in sorted({b[2], b[3]})]).reshape(-1, 2)
    return knots[:, 0], knots[:, 1]
