"""Small gradient-boosted classification trees in numpy, with isotonic calibration.

For classifiers that are fitted on a bounded sample. The trees are grown level
by level on histograms of gradients and hessians, and are full binary trees of
a fixed depth; a node without a useful split sends all rows to the left.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Trees:
    """``features`` and ``thresholds`` (trees x inner nodes, by level), ``leaves`` (trees x leaves)."""
    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray
    start: float
    depth: int

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of every row."""
        rows, out = np.arange(len(x)), np.full(len(x), self.start)
        for f, t, v in zip(self.features, self.thresholds, self.leaves):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2 ** self.depth - 1)]
        return out


def _grown(bins: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, l2: float, least: float):
    """One tree on binned rows: feature and bin of every inner node, node of every row."""
    n, d = bins.shape
    inner = 2 ** depth - 1
    feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, BINS)
    node, columns = np.zeros(n, dtype=np.int64), np.arange(d) * BINS
    for level in range(depth):
        first, k = 2 ** level - 1, 2 ** level
        cell = ((node - first)[:, None] * (d * BINS) + columns + bins).ravel()
        sums = [np.bincount(cell, np.repeat(w, d), k * d * BINS).reshape(k, d, BINS) for w in (g, h)]
        gl, hl = (np.cumsum(s, axis=2) for s in sums)
        gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
        gain = gl ** 2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt ** 2 / (ht + l2)
        gain[(hl < least) | (ht - hl < least)] = 0.0
        best = gain.reshape(k, -1).argmax(axis=1)
        use = gain.reshape(k, -1)[np.arange(k), best] > 1e-9
        feature[first:first + k] = np.where(use, best // BINS, 0)
        cut[first:first + k] = np.where(use, best % BINS, BINS)
        node = 2 * node + 1 + (bins[np.arange(n), feature[node]] > cut[node])
    return feature, cut, node - inner


def fitted(x: np.ndarray, y: np.ndarray, w: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2,
           l2: float = 1.0, least: float = 1.0) -> Trees:
    """Boosted trees for labels 0 and 1 under weights; no randomness."""
    edges = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS, method="lower")) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    start = float(np.log((w @ y + 1) / (w @ (1 - y) + 1)))
    margin = np.full(len(y), start)
    fs, ts, vs = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        f, c, leaf = _grown(bins, g, h, depth, l2, least)
        k = 2 ** depth
        v = -rate * np.bincount(leaf, g, k) / (np.bincount(leaf, h, k) + l2)
        margin += v[leaf]
        fs.append(f)
        ts.append([edges[i][b] if b < len(edges[i]) else np.inf for i, b in zip(f, c)])
        vs.append(v)
    return Trees(np.array(fs), np.array(ts), np.array(vs), start, depth)


def isotonic(margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(margins, probabilities): a step function that rises with the margin, by pooling adjacent violators.

    Blocks are smoothed with half a negative each, so that few rows don't make certainty.
    """
    order = np.argsort(margins, kind="stable")
    blocks: list[list[float]] = []  # start, positives, rows
    for m, v in zip(margins[order].tolist(), y[order].tolist()):
        if blocks and blocks[-1][0] == m:
            blocks[-1][1] += v
            blocks[-1][2] += 1
        else:
            blocks.append([m, v, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, p, n = blocks.pop()
            blocks[-1][1] += p
            blocks[-1][2] += n
    p = np.array([b[1] / (b[2] + 0.5) for b in blocks])
    return np.array([b[0] for b in blocks]), np.maximum.accumulate(p)


def calibrated(step: tuple[np.ndarray, np.ndarray], margins: np.ndarray) -> np.ndarray:
    at = np.searchsorted(step[0], margins, side="right") - 1
    return np.where(at < 0, 0.0, step[1][np.maximum(at, 0)])
