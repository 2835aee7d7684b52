"""A random forest over a few dense features, grown a tree per task.

Values become bins, one byte each, so the training rows of all tasks are a small array: a byte per feature, label and weight.
A tree is grown level by level from sums per node and bin, which is linear in its rows, and leaves its task as a few bytes
per node. No more than one tree is ever opened at once, and the driver sees none; votes are summed per distinct row of bins.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmark.session import stored

BINS = 32
LEAF = 255
# Rows of votes of a batch.
BATCH = 1 << 16


def _values(column: pa.Array, n_features: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n_features)


def _cuts(rows: DataFrame, n_features: int) -> list[np.ndarray]:
    """Per feature at most 31 values, each the last of its bin: all of them where there are few, else quantiles."""

    def few(batches):
        seen = [np.zeros(0)] * n_features
        for batch in batches:
            values = _values(batch.column(0), n_features)
            seen = [np.union1d(s, values[:, i])[: BINS + 1] for i, s in enumerate(seen)]
        yield pa.RecordBatch.from_arrays([pa.array(range(n_features), pa.int32()), pa.array(seen, pa.list_(pa.float64()))], names=["i", "seen"])

    seen = [np.zeros(0)] * n_features
    for r in rows.select("values").mapInArrow(few, "i int, seen array<double>").collect():
        seen[r["i"]] = np.union1d(seen[r["i"]], r["seen"])
    shares = [i / BINS for i in range(1, BINS)]
    many = [F.percentile_approx(F.get("values", F.lit(i)), shares, 10_000) for i in range(n_features)]
    quantiles = rows.agg(*many).first()
    return [s[:-1] if len(s) <= BINS else np.unique(q) for s, q in zip(seen, quantiles)]


def _binned(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, values[:, i]) for i, c in enumerate(cuts)], axis=1).astype(np.uint8)


def _sums(key: np.ndarray, size: int, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """The keys that occur, rising, and the sums of the weights over each."""
    if size <= 4 * len(key):
        n = np.bincount(key, minlength=size)
        found = np.flatnonzero(n)
        return found, *(np.bincount(key, w, size)[found] for w in weights)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], *(np.add.reduceat(w[order], first) for w in weights)


def _best_splits(x, node, weight, ones, impurity, total, total_ones, chosen) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, feature, last bin of the left side) per node, the gain being the decrease of the weighted Gini impurity."""
    nodes = len(total)
    gain, feature, cut = np.zeros(nodes), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
    rows = np.arange(len(x)) * x.shape[1]
    for own in chosen.T:
        key, s, s1 = _sums(node * BINS + x.ravel()[rows + own[node]], nodes * BINS, weight, ones)
        at = key // BINS
        new = np.concatenate(([True], at[1:] != at[:-1]))
        first = np.flatnonzero(new)
        left, left_ones = np.cumsum(s), np.cumsum(s1)
        left -= (left[first] - s[first])[at]
        left_ones -= (left_ones[first] - s1[first])[at]
        right, right_ones = total[at] - left, total_ones[at] - left_ones
        with np.errstate(divide="ignore", invalid="ignore"):
            after = left_ones * (left - left_ones) / left + right_ones * (right - right_ones) / right
        found = impurity[at] - 2 * after
        # nothing is to the right of a node's last bin
        found[np.append(new[1:], True)] = -1.0
        top = np.maximum.reduceat(found, first)
        hits = np.flatnonzero(found == top[at])
        hits = hits[np.concatenate(([True], at[hits][1:] != at[hits][:-1]))]
        better = top > gain
        gain[better], feature[better], cut[better] = top[better], own[better], key[hits][better] % BINS
    return gain, feature, cut


def _drawn(rng: np.random.Generator, nodes: int, n_features: int, draw: int) -> np.ndarray:
    """(node, draw): features drawn into a reservoir, whose order says which of equal gains wins, as in Spark ML."""
    chosen = np.tile(np.arange(draw), (nodes, 1))
    for i in range(draw, n_features):
        slot = rng.integers(0, i + 1, nodes)
        hit = np.flatnonzero(slot < draw)
        chosen[hit, slot[hit]] = i
    return chosen


def grow(x: np.ndarray, label: np.ndarray, weight: np.ndarray, max_depth: int, seed: list[int]) -> tuple[bytes, np.ndarray]:
    """A tree on rows drawn with replacement, a new draw of features per node; and how much each feature gained."""
    rng = np.random.default_rng(seed)
    times = rng.poisson(1.0, len(x))
    own = np.flatnonzero(times)
    x, weight = x[own], weight[own] * times[own]
    ones = weight * (label[own] == 1)
    node, nodes, n_features = np.zeros(len(own), np.int64), 1, x.shape[1]
    draw = max(1, int(np.ceil(np.sqrt(n_features))))
    features, cuts, shares, gained = [], [], [], np.zeros(n_features)
    for level in range(max_depth + 1):
        total, total_ones = np.bincount(node, weight, nodes), np.bincount(node, ones, nodes)
        feature, cut = np.full(nodes, LEAF, np.uint8), np.zeros(nodes, np.uint8)
        share = np.divide(total_ones, total, out=np.zeros(nodes), where=total > 0)
        impure = np.flatnonzero((share > 1e-12) & (share < 1 - 1e-12)) if level < max_depth else np.zeros(0, np.int64)
        if len(impure):
            place = np.full(nodes, -1)
            place[impure] = np.arange(len(impure))
            kept = place[node] >= 0
            x, weight, ones, node = x[kept], weight[kept], ones[kept], place[node[kept]]
            t, t1 = total[impure], total_ones[impure]
            chosen = _drawn(rng, len(impure), n_features, draw)
            gain, best, last = _best_splits(x, node, weight, ones, 2 * t1 * (t - t1) / t, t, t1, chosen)
            split = gain > 1e-9 * t
            feature[impure[split]], cut[impure[split]] = best[split], last[split]
            gained += np.bincount(best[split], gain[split], n_features)
            kept = split[node]
            x, weight, ones, node = x[kept], weight[kept], ones[kept], node[kept]
            right = x.ravel()[np.arange(len(x)) * n_features + best[node]] > last[node]
            node, nodes = 2 * (np.cumsum(split) - 1)[node] + right, 2 * int(split.sum())
        features.append(feature)
        cuts.append(cut[feature != LEAF])
        shares.append(share[feature == LEAF])
        if not len(impure) or not nodes:
            break
    tree = pickle.dumps(tuple(np.concatenate(p) for p in (features, cuts, shares)))
    return pickle.dumps((len(tree), pa.compress(tree, codec="zstd", asbytes=True))), gained / max(gained.sum(), 1e-300)


def votes(tree: bytes, x: np.ndarray) -> np.ndarray:
    """The share of class 1 in the leaf of each row; nodes lie level by level, so an inner node's children follow from its rank."""
    size, data = pickle.loads(tree)
    feature, inner_cuts, shares = pickle.loads(pa.decompress(data, size, codec="zstd", asbytes=True))
    inner = feature != LEAF
    rank = np.cumsum(inner) - 1
    cut = np.zeros(len(feature), np.uint8)
    cut[inner] = inner_cuts
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x) if inner[0] else 0)
    while len(rows):
        at = node[rows]
        at = 2 * rank[at] + 1 + (x[rows, feature[at]] > cut[at])
        node[rows] = at
        rows = rows[inner[at]]
    return shares[node - rank[node] - 1]


@dataclass
class Forest:
    """Trees as a table of (tree, nodes, gained), and the bins of the features."""

    trees: DataFrame
    n_trees: int
    cuts: list[np.ndarray]

    @classmethod
    def fit(cls, rows: DataFrame, n_features: int, n_trees: int, max_depth: int, seed: int) -> Forest:
        """``rows`` has ``values``, ``label`` and ``class_weight``."""
        spark = rows.sparkSession
        held = stored(rows.select("values", F.col("label").cast("int").alias("label"), F.col("class_weight").cast("double").alias("class_weight")), "forest-rows")
        cuts = _cuts(held, n_features)

        def pack(batches):
            for batch in batches:
                x = _binned(_values(batch.column(0), n_features), cuts)
                label, weight = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((x, label.astype(np.uint8), weight))], pa.binary())], names=["rows"])

        parts = [pickle.loads(bytes(r["rows"])) for r in held.mapInArrow(pack, "rows binary").collect()]
        x, label, weight = (np.concatenate(p) for p in zip((np.zeros((0, n_features), np.uint8), np.zeros(0, np.uint8), np.zeros(0)), *parts))
        # the order of equal content does not matter, so the trees do not depend on how the rows were dealt
        order = np.argsort(np.ascontiguousarray(np.column_stack((x, label))).view(f"S{n_features + 1}").ravel(), kind="stable")
        shared = spark.sparkContext.broadcast((x[order], label[order], weight[order]))

        def run(batches):
            x, label, weight = shared.value
            for batch in batches:
                for tree in batch.column(0).to_pylist():
                    nodes, gained = grow(x, label, weight, max_depth, [seed, tree])
                    yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int64()), pa.array([nodes], pa.binary()), pa.array([gained], pa.list_(pa.float64()))], names=["tree", "nodes", "gained"])

        tasks = min(n_trees, 4 * spark.sparkContext.defaultParallelism)
        grown = spark.range(0, n_trees, 1, tasks).mapInArrow(run, "tree bigint, nodes binary, gained array<double>")
        trees = stored(grown, "forest")
        shared.destroy()
        return cls(trees, n_trees, cuts)

    def score(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """Mean share of class 1 over the trees; ``rows`` has ``values``. Only distinct rows of bins meet the trees."""
        cuts, width = self.cuts, len(self.cuts)
        spark = rows.sparkSession

        def place(batches):
            for batch in batches:
                x = _binned(_values(batch.column(len(keep)), width), cuts)
                bins = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], bins], names=[*keep, "_x"])

        schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
        placed = stored(rows.select(*keep, "values").mapInArrow(place, f"{schema}, _x binary"), "forest-scored")
        distinct = b"".join(bytes(r["_x"]) for r in placed.select("_x").distinct().collect())
        shared = spark.sparkContext.broadcast(distinct)

        def run(batches):
            x = np.frombuffer(shared.value, dtype=np.uint8).reshape(-1, width)
            total = np.zeros(len(x))
            for batch in batches:
                for tree in batch.column(0):
                    total += votes(tree.as_py(), x)
            for first in range(0, len(x), BATCH):
                part = x[first : first + BATCH]
                bins = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(part), [None, pa.py_buffer(part.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([bins, pa.array(total[first : first + BATCH])], names=["_x", "votes"])

        counted = self.trees.select("nodes").mapInArrow(run, "_x binary, votes double").groupBy("_x")
        score = (F.sum("votes") / F.lit(float(self.n_trees))).alias("score")
        out = placed.join(counted.agg(score), "_x").select(*keep, "score")
        return out.withColumn("prediction", F.when(F.col("score") > 0.5, 1).otherwise(0))

    def importances(self) -> np.ndarray:
        """Per feature the mean over the trees of its share of the gain."""
        rows = self.trees.select(F.posexplode("gained").alias("i", "g")).groupBy("i").agg(F.sum("g").alias("g")).orderBy("i").collect()
        gained = np.array([r["g"] for r in rows])
        return gained / max(gained.sum(), 1e-300)

    def save(self, path: str) -> None:
        self.trees.write.mode("overwrite").parquet(f"{path}/trees")
        spark = self.trees.sparkSession
        rows = [(i, c.tolist(), self.n_trees) for i, c in enumerate(self.cuts)]
        spark.createDataFrame(rows, "i int, cuts array<double>, trees int").write.mode("overwrite").parquet(f"{path}/cuts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        rows = spark.read.parquet(f"{path}/cuts").orderBy("i").collect()
        return cls(spark.read.parquet(f"{path}/trees"), rows[0]["trees"], [np.array(r["cuts"], dtype=np.float64) for r in rows])
