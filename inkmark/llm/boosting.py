"""Gradient-boosted trees for two classes: log-loss, binned features, Newton leaves.

Trees grow by histograms of gradients over (feature, bin, node). These are sums of integers, so rows may be counted in any
order and in any parts: in memory, or by a Spark job per level over a table of any size, with the same trees.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmark.llm.arrow import map_batches

TREES, DEPTH, BINS = 40, 3, 32
# Gradients are counted in units of 1 / UNIT, margins for thresholds in units of 1 / MARGIN.
UNIT = 1 << 20
MARGIN = 64


def quantile_cuts(values: np.ndarray, counts: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The distinct quantiles between bins of a feature whose rising values occur so often."""
    if not len(values):
        return np.zeros(0)
    last = np.cumsum(counts)
    at = np.linspace(0, 1, bins + 1)[1:-1] * (last[-1] - 1)
    low, high = (values[np.searchsorted(last, f(at), side="right")] for f in (np.floor, np.ceil))
    return np.unique(low + (high - low) * (at - np.floor(at)))


def coded(rows: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The bin of each feature, one byte each."""
    return np.stack([np.searchsorted(c, x, side="right") for c, x in zip(cuts, rows.T)], axis=1).astype(np.uint8)


class BoostedTrees:
    """Trees of a fixed depth stored as arrays; small enough to travel with a task's function."""

    def __init__(self, rows: np.ndarray, target: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = 0.3, bins: int = BINS, leaf: float = 5.0):
        cuts = [quantile_cuts(*np.unique(c, return_counts=True), bins) for c in rows.T]
        codes, n = coded(rows, cuts), np.ones(len(rows), dtype=np.int64)
        self.grow(cuts, float(target.sum()), len(target), lambda: self.histograms(codes, target, n), trees, depth, rate, leaf)

    @classmethod
    def of_codes(cls, cuts: list[np.ndarray], codes: np.ndarray, target: np.ndarray, n: np.ndarray) -> BoostedTrees:
        """Trees from coded rows that occur ``n`` times."""
        out = cls.__new__(cls)
        out.grow(cuts, float(target @ n), int(n.sum()), lambda: out.histograms(codes, target, n))
        return out

    @classmethod
    def of_table(cls, cuts: list[np.ndarray], rows: DataFrame) -> BoostedTrees:
        """The same trees from a table (target int, codes binary, n bigint): a job per level, which returns histograms only."""
        out = cls.__new__(cls)

        def count(batch):
            cells = out.histograms(*arrays(batch, len(cuts))).reshape(2, -1)
            at = np.flatnonzero(cells.any(axis=0))
            return {"cell": at, "g": cells[0, at], "h": cells[1, at]}

        def histograms():
            sums = map_batches(rows, count, "cell int, g bigint, h bigint").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            cells = np.zeros((2, out.width << out.level, BINS), dtype=np.int64)
            flat = cells.reshape(2, -1)
            for r in sums.collect():
                flat[:, r.cell] = r.g, r.h
            return cells.reshape(2, out.width, 1 << out.level, BINS)

        total = rows.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("target")).alias("hits")).first()
        out.grow(cuts, float(total.hits or 0), int(total.n or 0), histograms)
        return out

    def grow(self, cuts, hits: float, total: int, histograms: Callable, trees: int = TREES, depth: int = DEPTH, rate: float = 0.3, leaf: float = 5.0) -> None:
        """Complete trees, level by level: feature, threshold and bin per inner node, value per leaf."""
        self.depth, self.trees, self.width = depth, [], len(cuts)
        self.base = float(np.log((hits + 1) / (total - hits + 1)))
        for _ in range(trees):
            inner = (1 << depth) - 1
            # a bin beyond all sends every row to the left
            feature, threshold, split = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), np.full(inner, 255)
            self.open = feature, split
            for self.level in range(depth):
                first, count = (1 << self.level) - 1, 1 << self.level
                g, h = (x.cumsum(axis=2) / UNIT for x in histograms())
                if self.level == depth - 1:
                    last_g, last_h = g, h
                best = np.full(count, 1e-9)
                for f, cut in enumerate(cuts):
                    if not len(cut):
                        continue
                    a, b = g[f], h[f]
                    gain = a**2 / (b + leaf) + (a[:, -1:] - a) ** 2 / (b[:, -1:] - b + leaf) - a[:, -1:] ** 2 / (b[:, -1:] + leaf)
                    at = gain[:, : len(cut)].argmax(axis=1)
                    for node in np.flatnonzero(gain[np.arange(count), at] > best).tolist():
                        best[node] = gain[node, at[node]]
                        feature[first + node], threshold[first + node], split[first + node] = f, cut[at[node]], at[node]
            # the leaves' sums lie in the histograms of the last level, left and right of its splits
            nodes, f, at = np.arange(count), feature[first:], np.minimum(split[first:], last_g.shape[2] - 1)
            left = np.stack([x[f, nodes, at] for x in (last_g, last_h)])
            whole = np.stack([x[f, nodes, -1] for x in (last_g, last_h)])
            sums = np.stack([left, whole - left], axis=2).reshape(2, -1)
            self.trees.append((feature, threshold, rate * sums[0] / (sums[1] + leaf), split))
        del self.open

    def histograms(self, codes: np.ndarray, target: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Sums of gradients and of their weights per feature, node of the open level and bin."""
        at = np.arange(len(codes))
        chance = 1 / (1 + np.exp(-self.code_margins(codes)))
        feature, split = self.open
        node = np.zeros(len(codes), dtype=np.int64)
        for _ in range(self.level):
            node = 2 * node + 1 + (codes[at, feature[node]] > split[node])
        node -= (1 << self.level) - 1
        sums = [np.rint((target - chance) * UNIT) * n, np.rint(chance * (1 - chance) * UNIT) * n]
        size = BINS << self.level
        keys = (node[:, None] * BINS + codes).T
        cells = [[np.bincount(k, x, size) for k in keys] for x in sums]
        return np.array(cells).astype(np.int64).reshape(2, self.width, 1 << self.level, BINS)

    def code_margins(self, codes: np.ndarray) -> np.ndarray:
        """Log-odds of class 1 per coded row."""
        at, margin = np.arange(len(codes)), np.full(len(codes), self.base)
        for feature, _, value, split in self.trees:
            node = np.zeros(len(codes), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (codes[at, feature[node]] > split[node])
            margin += value[node - len(feature)]
        return margin

    def _apply(self, tree, rows: np.ndarray) -> np.ndarray:
        feature, threshold, value, _ = tree
        node = np.zeros(len(rows), dtype=np.int64)
        at = np.arange(len(rows))
        for _ in range(self.depth):
            node = 2 * node + 1 + (rows[at, feature[node]] >= threshold[node])
        return value[node - len(feature)]

    def chances(self, rows: np.ndarray) -> np.ndarray:
        """Probability of class 1 per row."""
        if not len(rows):
            return np.zeros(0)
        margin = np.full(len(rows), self.base)
        for tree in self.trees:
            margin += self._apply(tree, rows)
        return 1 / (1 + np.exp(-margin))


def arrays(batch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, targets and counts of a batch of (target, codes, n, ...)."""
    codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(-1, width)
    return codes, batch.column(0).to_numpy().astype(np.float64), batch.column(2).to_numpy()


def cautious_threshold(chances: np.ndarray, target: np.ndarray, precision: float, n: np.ndarray | int = 1) -> float:
    """The lowest cut above which held-out rows (which occur ``n`` times) are positive at least with this precision; above 1 if there is none."""
    order = np.argsort(-chances, kind="stable")
    n = np.broadcast_to(n, len(order))[order]
    reached = np.cumsum(target[order] * n) / np.cumsum(n) >= precision
    # equal chances stand or fall together
    last = np.append(chances[order][1:] != chances[order][:-1], True)
    good = np.flatnonzero(reached & last)
    return float(chances[order][good[-1]]) if len(good) else 2.0
