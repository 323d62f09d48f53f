"""Learned partitions of a vector space, on a sample of bounded size, in numpy.

The sample's neighbour graph is cut into parts of equal size that share few
edges, and a small classifier learns which part a vector belongs to.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

NEIGHBOURS, HIDDEN = 10, 96


def neighbour_graph(x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """The ``k`` rows of largest inner product of each row but itself, by blocks."""
    k = min(k, len(x) - 1)
    found = np.empty((len(x), k), np.int64)
    for start in range(0, len(x), 512):
        near = x[start : start + 512] @ x.T
        near[np.arange(len(near)), np.arange(start, start + len(near))] = -np.inf
        found[start : start + 512] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return found


def _halves(edges: np.ndarray, n: int, draw: np.random.Generator, steps: int = 60, swaps: int = 8) -> np.ndarray:
    """Cut a graph into two halves of equal size: spectral order, then exchanges of the pairs that gain most."""
    a, b = np.concatenate([edges, edges[:, ::-1]]).T if len(edges) else (np.empty(0, np.int64),) * 2
    degree = np.bincount(a, minlength=n) + 1.0
    value = draw.normal(size=n)
    for _ in range(steps):
        value = (value + np.bincount(a, value[b], n)) / degree
        value -= (value * degree).sum() / degree.sum()
        value /= np.abs(value).max() or 1.0
    side = np.zeros(n, bool)
    side[np.argsort(value, kind="stable")[n // 2 :]] = True
    for _ in range(swaps):
        same = np.bincount(a, side[a] == side[b], n)
        gain = np.bincount(a, minlength=n) - 2 * same
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        pairs = min(len(left), len(right))
        good = int((gain[left[:pairs]] + gain[right[:pairs]] > 0).sum()) // 4  # few at a time: exchanges change each other's gain
        if not good:
            break
        side[left[:good]], side[right[:good]] = True, False
    return side


def balanced_parts(graph: np.ndarray, levels: int, seed: int = 3) -> np.ndarray:
    """Part of each row: 2^levels parts whose sizes differ by the rounding of halves only."""
    draw = np.random.default_rng(seed)
    n, k = graph.shape
    edges = np.stack([np.repeat(np.arange(n), k), graph.ravel()], axis=1)
    part = np.zeros(n, np.int64)
    for _ in range(levels):
        split = np.zeros(n, np.int64)
        for p in np.unique(part):
            rows = np.flatnonzero(part == p)
            place = np.full(n, -1)
            place[rows] = np.arange(len(rows))
            inside = place[edges]
            split[rows] = _halves(inside[(inside >= 0).all(axis=1)], len(rows), draw)
        part = 2 * part + split
    return part


@dataclass
class Router:
    """Classifier from a vector to the log-probabilities of the parts."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    @classmethod
    def train(cls, x: np.ndarray, part: np.ndarray, parts: int, hidden: int = HIDDEN, passes: int = 20, seed: int = 4) -> Router:
        draw = np.random.default_rng(seed)
        d = x.shape[1]
        weights = [
            draw.normal(0, np.sqrt(2 / d), (d, hidden)).astype(np.float32), np.zeros(hidden, np.float32),
            draw.normal(0, np.sqrt(1 / hidden), (hidden, parts)).astype(np.float32), np.zeros(parts, np.float32),
        ]
        first, second, turn = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for number in range(passes):
            order = draw.permutation(len(x))
            rate = 0.003 * (1 - number / passes)
            for start in range(0, len(x), 256):
                rows = order[start : start + 256]
                inner = np.maximum(x[rows] @ weights[0] + weights[1], 0)
                logits = inner @ weights[2] + weights[3]
                share = np.exp(logits - logits.max(axis=1, keepdims=True))
                share /= share.sum(axis=1, keepdims=True)
                share[np.arange(len(rows)), part[rows]] -= 1
                share /= len(rows)
                back = (share @ weights[2].T) * (inner > 0)
                grads = [x[rows].T @ back, back.sum(axis=0), inner.T @ share, share.sum(axis=0)]
                turn += 1
                for w, g, a, b in zip(weights, grads, first, second, strict=True):
                    g = g + np.float32(1e-4) * w
                    a += np.float32(0.1) * (g - a)
                    b += np.float32(0.01) * (g * g - b)
                    w -= np.float32(rate * np.sqrt(1 - 0.99**turn) / (1 - 0.9**turn)) * a / (np.sqrt(b) + np.float32(1e-8))
        return cls(*weights)
