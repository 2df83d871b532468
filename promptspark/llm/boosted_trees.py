"""Gradient-boosted regression trees for a few classes, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Softmax boosting: each round fits one tree of ``depth`` levels per class to the
    gradients of a random ``share`` of the rows (a fixed seed), on features cut into at
    most ``bins`` quantile bins."""

    def __init__(self, classes: int, rounds: int = 45, depth: int = 5, rate: float = 0.25, bins: int = 24,
                 least: float = 4.0, ridge: float = 1.0, share: float = 0.25):
        self.classes, self.rounds, self.depth, self.rate = classes, rounds, depth, rate
        self.bins, self.least, self.ridge, self.share = bins, least, ridge, share

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Bin of each value."""
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1).astype(np.uint8)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        shares = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(x[:, j], shares)) for j in range(x.shape[1])]
        cells = self.cells(x)
        wanted = np.eye(self.classes)[y]
        self.base = np.log(np.maximum(wanted.mean(axis=0), 1e-6))
        score = np.tile(self.base, (len(y), 1))
        self.features = np.zeros((self.rounds, self.classes, 2 ** self.depth - 1), np.int64)
        self.limits = np.full(self.features.shape, 255, np.uint8)
        self.leaves = np.zeros((self.rounds, self.classes, 2 ** self.depth))
        spread = cells + np.arange(cells.shape[1]) * self.bins  # a histogram slot by feature and bin
        rng = np.random.default_rng(1)
        for r in range(self.rounds):
            p = softmax(score)
            some = rng.random(len(y)) < self.share if len(y) * self.share > 1000 else np.ones(len(y), bool)
            for c in range(self.classes):
                g, h = p[some, c] - wanted[some, c], np.maximum(p[some, c] * (1 - p[some, c]), 1e-6)
                self._grow(r, c, cells[some], spread[some], g, h)
                score[:, c] += self.leaves[r, c, self.leaf(r, c, cells)]
        return self

    def leaf(self, r: int, c: int, cells: np.ndarray) -> np.ndarray:
        """Leaf of each row in one tree."""
        at, rows = np.zeros(len(cells), np.int64), np.arange(len(cells))
        for level in range(self.depth):
            node = 2 ** level - 1 + at
            at = 2 * at + (cells[rows, self.features[r, c, node]] > self.limits[r, c, node])
        return at

    def _grow(self, r, c, cells, spread, g, h) -> None:
        at = np.zeros(len(g), np.int64)
        width = cells.shape[1] * self.bins
        for level in range(self.depth):
            nodes, first = 2 ** level, 2 ** level - 1
            slots = (spread + (at * width)[:, None]).ravel()
            g_sum, h_sum = (np.bincount(slots, np.repeat(w, cells.shape[1]), nodes * width).reshape(
                nodes, cells.shape[1], self.bins).cumsum(axis=2) for w in (g, h))
            g_all, h_all = g_sum[:, :1, -1:], h_sum[:, :1, -1:]
            left, right = g_sum ** 2 / (h_sum + self.ridge), (g_all - g_sum) ** 2 / (h_all - h_sum + self.ridge)
            gain = left + right - g_all ** 2 / (h_all + self.ridge)
            gain[(h_sum < self.least) | (h_all - h_sum < self.least)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            useful = gain.reshape(nodes, -1).max(axis=1) > 1e-9
            self.features[r, c, first:first + nodes] = np.where(useful, best // self.bins, 0)
            self.limits[r, c, first:first + nodes] = np.where(useful, best % self.bins, 255)
            f, limit = self.features[r, c, first + at], self.limits[r, c, first + at]
            at = 2 * at + (cells[np.arange(len(at)), f] > limit)
        size = 2 ** self.depth
        g_sum, h_sum = np.bincount(at, g, size), np.bincount(at, h, size)
        self.leaves[r, c] = -self.rate * g_sum / (h_sum + self.ridge)

    def log_shares(self, x: np.ndarray) -> np.ndarray:
        """Logarithms of the classes' probabilities."""
        cells = self.cells(x)
        score = np.tile(self.base, (len(x), 1))
        for r in range(self.rounds):
            for c in range(self.classes):
                score[:, c] += self.leaves[r, c, self.leaf(r, c, cells)]
        return np.log(np.maximum(softmax(score), 1e-9))


def softmax(score: np.ndarray) -> np.ndarray:
    e = np.exp(score - score.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)
