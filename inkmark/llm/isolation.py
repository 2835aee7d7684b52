"""An isolation forest in numpy: anomalies are isolated by few random splits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def _average_path(n: np.ndarray | float) -> np.ndarray:
    """Expected depth of an unsuccessful search in a random binary tree of n rows."""
    n = np.asarray(n, dtype=np.float64)
    inner = np.maximum(n - 1, 1)
    return np.where(n > 2, 2 * (np.log(inner) + np.euler_gamma) - 2 * inner / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees as arrays of (feature, threshold, left, right, length); a leaf points to itself.

    ``weights`` are the odds with which a feature is drawn for a split (default: equal). Each tree draws its splits from
    ``sample`` rows of its own, as the method has it; ``weigh`` replaces the leaves' masses by those of any number of rows.
    """

    def __init__(self, rows: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 1, weights: np.ndarray | None = None):
        rng = np.random.default_rng(seed)
        self.weights = np.ones(rows.shape[1]) if weights is None else weights
        self.sample = min(sample, len(rows))
        self.depth = max(1, int(np.ceil(np.log2(max(2, self.sample)))))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.sample, replace=False)], rng) for _ in range(trees)]

    def _grow(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, threshold, left, right, length = [], [], [], [], []

        def add(part: np.ndarray, depth: int) -> int:
            node = len(feature)
            for column, value in ((feature, 0), (threshold, np.inf), (left, node), (right, node), (length, depth + float(_average_path(len(part))))):
                column.append(value)
            low, high = part.min(axis=0), part.max(axis=0)
            open_columns = np.flatnonzero(high > low)
            if depth < self.depth and len(part) > 1 and len(open_columns):
                odds = self.weights[open_columns]
                column = int(rng.choice(open_columns, p=odds / odds.sum()))
                cut = rng.uniform(low[column], high[column])
                below = part[:, column] < cut
                if below.any() and not below.all():
                    feature[node], threshold[node] = column, cut
                    left[node], right[node] = add(part[below], depth + 1), add(part[~below], depth + 1)
            return node

        add(rows, 0)
        return tuple(np.array(x) for x in (feature, threshold, left, right, length))

    def leaves(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        """Per tree, the leaf of each row."""
        at = np.arange(len(rows))
        for feature, threshold, left, right, _ in self.trees:
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                node = np.where(rows[at, feature[node]] < threshold[node], left[node], right[node])
            yield node

    def weigh(self, masses: list[np.ndarray]) -> None:
        """Expected path lengths from the mass of rows in each leaf of each tree."""
        paths = _average_path(np.arange(self.sample + 1))
        for i, ((feature, threshold, left, right, _), mass) in enumerate(zip(self.trees, masses)):
            depth = np.zeros(len(left))
            for node in range(len(left)):
                if left[node] != node:
                    depth[left[node]] = depth[right[node]] = depth[node] + 1
            size = self.sample * mass / max(mass.sum(), 1e-9)
            self.trees[i] = feature, threshold, left, right, depth + np.interp(size, np.arange(self.sample + 1), paths)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly in (0, 1) per row; higher is more unusual."""
        total = np.zeros(len(rows))
        for node, tree in zip(self.leaves(rows), self.trees):
            total += tree[4][node]
        return 2.0 ** (-total / len(self.trees) / max(float(_average_path(self.sample)), 1e-9))
