"""Gradient-boosted trees over binned features and isotonic calibration, trained on the driver.

The training set is a bounded sample; scoring is a vectorised walk that ships with the task closure.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    base: float = 0.0
    depth: int = 3

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1).astype(np.int32)

    def fit(self, x, y, weight, n_trees=80, rate=0.2, bins=24, l2=2.0, least=4.0) -> "BoostedTrees":
        self.edges = []
        for j in range(x.shape[1]):
            v = np.unique(x[:, j])
            mid = (v[1:] + v[:-1]) / 2
            self.edges.append(mid if len(mid) < bins else np.unique(np.quantile(mid, np.linspace(0, 1, bins))))
        b = self.binned(x)
        n_features, n_bins = x.shape[1], max([len(e) for e in self.edges] + [0]) + 1
        mean = float(np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4)) if len(y) else 0.5
        self.base = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.base)
        spot = b + np.arange(n_features) * n_bins
        self.trees = []
        for _ in range(n_trees if len(y) else 0):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (y - p), weight * p * (1 - p)
            node = np.zeros(len(y), np.int64)
            n_nodes = 2 ** (self.depth + 1) - 1
            feature, threshold, value = np.full(n_nodes, -1), np.zeros(n_nodes, np.int64), np.zeros(n_nodes)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                local = node - first
                inside = local >= 0
                at = (local[inside][:, None] * (n_features * n_bins) + spot[inside]).ravel()
                size = width * n_features * n_bins
                gs = np.bincount(at, np.repeat(g[inside], n_features), size).reshape(width, n_features, n_bins)
                hs = np.bincount(at, np.repeat(h[inside], n_features), size).reshape(width, n_features, n_bins)
                gl, hl = gs.cumsum(2), hs.cumsum(2)
                gt, ht = gl[:, :, -1:], hl[:, :, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < least / 4) | (ht - hl < least / 4)] = 0
                best = gain.reshape(width, -1).argmax(1)
                for k in range(width):
                    if gain.reshape(width, -1)[k, best[k]] > 1e-6:
                        feature[first + k], threshold[first + k] = divmod(best[k], n_bins)
                split = inside & (feature[node] >= 0)
                rows = np.flatnonzero(split)
                right = b[rows, feature[node[rows]]] > threshold[node[rows]]
                node[rows] = 2 * node[rows] + 1 + right
                node[inside & ~split] = node[inside & ~split]
            gsum, hsum = np.bincount(node, g, n_nodes), np.bincount(node, h, n_nodes)
            value = rate * gsum / (hsum + l2)
            self.trees.append((feature, threshold, value))
            score += value[node]
        return self

    def decision(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not len(x):
            return out
        b = self.binned(x)
        rows = np.arange(len(x))
        for feature, threshold, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                go = f >= 0
                right = b[rows, np.maximum(f, 0)] > threshold[node]
                node = np.where(go, 2 * node + 1 + right, node)
            out += value[node]
        return out


@dataclass
class Isotonic:
    """Pool adjacent violators; between the pooled points the calibration is linear."""

    x: np.ndarray
    y: np.ndarray

    @classmethod
    def fit(cls, score, y, weight) -> "Isotonic":
        if not len(score):
            return cls(np.array([0.0]), np.array([0.0]))
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # sum of y, weight, first score, last score
        for s, t, w in zip(score[order], y[order], weight[order], strict=True):
            blocks.append([t * w, w, s, s])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                a, b, _, last = blocks.pop()
                blocks[-1][0] += a
                blocks[-1][1] += b
                blocks[-1][3] = last
        xs = np.array([v for b in blocks for v in (b[2], b[3])])
        ys = np.array([v for b in blocks for v in (b[0] / b[1],) * 2])
        return cls(xs, ys)

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y)
