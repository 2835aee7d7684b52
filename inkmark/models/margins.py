"""Linear margins of sparse rows: squared-hinge and logistic machines, several fitted in the same passes over the rows."""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame

# Cells of a block of rows; this bounds what a task holds at once.
BLOCK = 1 << 20
# Rows per task, and tasks whose gradients are summed without a shuffle; both change no result.
ROWS_PER_TASK = 2500
DIRECT = 32
MEMORY = 10
# Steps over which a machine's objective must still fall by more than the tolerance's share of it.
PATIENCE = 10
# Bytes of blocks that one task may step over by itself; more are stepped over by a job per step, with the same result.
ALONE = 64 << 20


@dataclass
class Margin:
    """One linear function of a row's cells."""

    weights: np.ndarray
    bias: float


def _slices(lists: pa.ListArray):
    """(first, end) of runs of rows with about ``BLOCK`` cells."""
    ends = lists.offsets.to_numpy()[1:].astype(np.int64) - lists.offsets[0].as_py()
    cuts = np.flatnonzero(np.diff(ends // BLOCK)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(lists)])


def _sparse(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells of each row, feature id, value)."""
    cells = lists.flatten()
    return np.diff(lists.offsets.to_numpy()), cells.field(0).to_numpy(zero_copy_only=False), cells.field(1).to_numpy(zero_copy_only=False)


def _margins(sizes, ids, values, weights: np.ndarray, biases: np.ndarray) -> np.ndarray:
    """(rows, machines); a row's cells are neighbours."""
    some = sizes > 0
    first = (np.cumsum(sizes) - sizes)[some]
    out = np.zeros((len(sizes), len(weights)))
    ids = ids.astype(np.int64, copy=False)
    for k, w in enumerate(weights if len(first) else ()):
        out[some, k] = np.add.reduceat(values * w.take(ids), first)
    return out + biases


def add_margins(rows: DataFrame, machines: list[Margin], keep: list[str]) -> DataFrame:
    """``keep`` and ``margins``, an array with one number per machine, in one pass over the rows."""
    context = rows.sparkSession.sparkContext
    shared = context.broadcast((np.stack([m.weights for m in machines]), np.array([m.bias for m in machines])))

    def run(batches):
        weights, biases = shared.value
        for batch in batches:
            lists = batch.column(len(keep))
            for first, end in _slices(lists) if batch.num_rows else ():
                part = batch.slice(first, end - first)
                found = _margins(*_sparse(part.column(len(keep))), weights, biases)
                ends = np.arange(part.num_rows + 1, dtype=np.int32) * len(machines)
                out = pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], out], names=[*keep, "margins"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, "_cells").mapInArrow(run, f"{schema}, margins array<double>")


class Blocks:
    """Rows held as compact blocks: a cell takes six to eight bytes, and no wider form of the rows is kept for the steps.

    ``rows`` has ``_cells``, ``label``, ``class_weight`` and ``_fold``. Every row is made once, in as many tasks as its table has.
    """

    def __init__(self, rows: DataFrame, n_features: int, kind=np.float32):
        self.spark, self.n_features = rows.sparkSession, n_features
        wide = n_features > 1 << 16

        def pack(batches):
            for batch in batches:
                for first, end in _slices(batch.column(0)) if batch.num_rows else ():
                    part = batch.slice(first, end - first)
                    sizes, ids, values = _sparse(part.column(0))
                    sizes = sizes.astype(np.int32)
                    high = (ids >> 16).astype(np.uint8) if wide else None
                    label, weight, fold = (part.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
                    block = sizes, ids.astype(np.uint16), high, values.astype(kind), label, weight, fold
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], names=["block"])

        columns = rows.selectExpr("_cells", "cast(label AS int) label", "cast(class_weight AS double) class_weight", "cast(_fold AS int) _fold")
        self.held = columns.mapInArrow(pack, "block binary").rdd.map(lambda r: bytes(r[0])).persist(StorageLevel.MEMORY_AND_DISK)
        counts = self.held.map(lambda b: np.append(len(b), np.bincount(pickle.loads(b)[6], minlength=1))).fold(np.zeros(1, dtype=np.int64), _longer_sum)
        self.bytes, *self.sizes = counts.tolist()
        self.sizes = self.sizes or [0]

    @property
    def count(self) -> int:
        return sum(self.sizes)

    def total(self, function, shape: tuple[int, ...]) -> np.ndarray:
        """The sum over all blocks of an array of that shape. A step is one short job: no more tasks than slots."""
        context = self.spark.sparkContext
        tasks = max(1, min(self.held.getNumPartitions(), context.defaultParallelism, -(-self.count // ROWS_PER_TASK)))

        def of_task(part):
            total = np.zeros(shape)
            for block in part:
                total += function(_opened(block))
            yield total

        parts = self.held.coalesce(tasks).mapPartitions(of_task)
        return parts.reduce(np.add) if tasks <= DIRECT else parts.treeReduce(np.add)

    def margins(self, machines: list[Margin]) -> DataFrame:
        """``label``, ``_fold`` and ``margins``, an array with one number per machine, of all rows."""
        shared = self.spark.sparkContext.broadcast((np.stack([m.weights for m in machines]), np.array([m.bias for m in machines])))

        def run(batches):
            weights, biases = shared.value
            for batch in batches:
                for block in batch.column(0).to_pylist():
                    sizes, ids, values, label, _, fold = _opened(block)
                    found = _margins(sizes, ids, values, weights, biases)
                    ends = pa.array(np.arange(len(label) + 1, dtype=np.int32) * len(machines))
                    out = [pa.array(label), pa.array(fold), pa.ListArray.from_arrays(ends, pa.array(found.ravel()))]
                    yield pa.RecordBatch.from_arrays(out, names=["label", "_fold", "margins"])

        blocks = self.spark.createDataFrame(self.held.map(lambda b: (bytearray(b),)), "block binary")
        return blocks.mapInArrow(run, "label int, _fold int, margins array<double>")

    def unpersist(self) -> None:
        self.held.unpersist()


def _longer_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(max(len(a), len(b)), dtype=np.int64)
    out[: len(a)] += a
    out[: len(b)] += b
    return out


def _opened(block: bytes) -> tuple[np.ndarray, ...]:
    """(cells of each row, feature id, value, label, weight, fold)"""
    sizes, low, high, *rest = pickle.loads(block)
    ids = low.astype(np.int64)
    if high is not None:
        ids |= high.astype(np.int64) << 16
    return sizes, ids, *rest


def _loss(block: tuple[np.ndarray, ...], weights: np.ndarray, folds: list[int], logistic: bool = False) -> np.ndarray:
    """Per machine: gradient, that of the bias, loss. A machine passes over the rows of all folds but its own."""
    sizes, ids, values, label, weight, fold = block
    sign = np.where(label == 1, 1.0, -1.0)
    size = weights.shape[1] - 1
    margins = _margins(sizes, ids, values, weights[:, :size], weights[:, size])
    out = np.empty((len(folds), size + 2))
    for k, own in enumerate(folds):
        used = np.where(fold == own, 0.0, weight)
        side = sign * margins[:, k]
        if logistic:
            wrong = np.exp(-np.logaddexp(0.0, side))
            slope, loss = -used * sign * wrong, used * np.logaddexp(0.0, -side)
        else:
            short = np.maximum(1.0 - side, 0.0)
            slope, loss = -2.0 * used * sign * short, used * short * short
        out[k, :size] = np.bincount(ids, values * np.repeat(slope, sizes), size)
        out[k, size], out[k, size + 1] = slope.sum(), loss.sum()
    return out


def _logistic(block: tuple[np.ndarray, ...], weights: np.ndarray, bias: float) -> np.ndarray:
    """Gradient of the weighted logistic loss over the rows of fold 0, that of the bias last."""
    sizes, ids, values, label, weight, fold = block
    margin = _margins(sizes, ids, values, weights[None, :], np.array([bias]))[:, 0]
    residual = np.where(fold == 0, (1.0 / (1.0 + np.exp(-margin)) - label) * weight, 0.0)
    return np.append(np.bincount(ids, values * np.repeat(residual, sizes), len(weights)), residual.sum())


def logistic_gradient(blocks: Blocks, weights: np.ndarray, bias: float) -> np.ndarray:
    """The sum over the rows of fold 0; only it, as long as the vocabulary's limit, reaches the driver."""
    shared = blocks.spark.sparkContext.broadcast((weights, bias))
    total = blocks.total(lambda block: _logistic(block, *shared.value), (len(weights) + 1,))
    shared.destroy()
    return total


def _dot(a: np.ndarray, b: np.ndarray) -> float:
    """Summed by this thread: the threads of a BLAS would spin between the steps."""
    return float(np.einsum("i,i", a, b))


def _direction(gradient: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The two-loop recursion of L-BFGS."""
    q, shares = gradient.copy(), []
    for s, y in reversed(past):
        shares.append(_dot(s, q) / _dot(s, y))
        q -= shares[-1] * y
    if past:
        s, y = past[-1]
        q *= _dot(s, y) / _dot(y, y)
    for (s, y), share in zip(past, reversed(shares)):
        q += (share - _dot(y, q) / _dot(s, y)) * s
    return -q


def fit_squared_hinge(
    rows: DataFrame, n_features: int, n_rows: int | None = None, folds: tuple[int, ...] = (-1,), max_iter: int = 1000, tolerance: float = 1e-4
) -> list[Margin]:
    """``fit_blocks`` on rows that are not packed yet; their number is counted as they are packed."""
    blocks = Blocks(rows, n_features)
    machines = fit_blocks(blocks, folds, max_iter, tolerance)
    blocks.unpersist()
    return machines


def fit_blocks(
    blocks: Blocks, folds: tuple[int, ...] = (-1,), max_iter: int = 1000, tolerance: float = 1e-4, logistic: bool = False, alone: int = ALONE
) -> list[Margin]:
    """One machine per entry of ``folds``, fitted on the rows whose ``_fold`` is another.

    Minimises sum(class_weight * loss) + |w|^2 / 2 until no machine's objective fell by more than ``tolerance`` of it in ten
    steps. The loss is max(0, 1 - margin)^2 with the bias among the weights w, or the logistic one with a free bias. All machines
    share each step's pass over the rows; only their losses and gradients, as long as the vocabulary's limit, reach the driver.
    Blocks of up to ``alone`` bytes are stepped over inside one task.
    """
    context, folds, n_rows = blocks.spark.sparkContext, list(folds), blocks.count
    shape = len(folds), blocks.n_features + 1

    def solved(total) -> np.ndarray:
        """``total(function, shape, weights)`` is the sum over the blocks."""

        def evaluate(point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            weights = point.reshape(shape).copy()
            sums = total(lambda block, w: _loss(block, w, folds, logistic), (shape[0], shape[1] + 1), weights)
            if logistic:
                weights[:, -1] = 0.0
            loss = sums[:, -1] + (weights * weights).sum(axis=1) / 2
            return loss / n_rows, (sums[:, :-1] + weights).ravel() / n_rows

        return _minimised(evaluate, shape, max_iter, tolerance).reshape(shape)

    if blocks.bytes > alone:

        def by_jobs(function, size: tuple[int, ...], *point: np.ndarray) -> np.ndarray:
            shared = context.broadcast(point)
            found = blocks.total(lambda block: function(block, *shared.value), size)
            shared.destroy()
            return found

        weights = solved(by_jobs)
    else:

        def by_itself(part):
            held = [_opened(b) for b in part]
            yield solved(lambda function, size, *point: sum((function(b, *point) for b in held), np.zeros(size)))

        (weights,) = blocks.held.coalesce(1).mapPartitions(by_itself).collect()
    return [Margin(w[:-1].copy(), float(w[-1])) for w in weights]


def _minimised(evaluate, shape: tuple[int, int], max_iter: int, tolerance: float) -> np.ndarray:
    """The point that L-BFGS finds; ``evaluate`` gives the machines' objectives and the gradient of their sum."""
    point = np.zeros(shape[0] * shape[1])
    losses, gradient = evaluate(point)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    history = [losses]
    for _ in range(max_iter):
        if len(history) > PATIENCE and (history[-1 - PATIENCE] - losses <= tolerance * losses).all():
            break
        direction = _direction(gradient, past)
        slope = _dot(direction, gradient)
        step = 1.0 if past else 1.0 / max(np.sqrt(_dot(gradient, gradient)), 1e-12)
        while True:
            moved = point + step * direction
            new_losses, new_gradient = evaluate(moved)
            if new_losses.sum() <= losses.sum() + 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        if step < 1e-10:
            break
        s, y = moved - point, new_gradient - gradient
        if _dot(s, y) > 1e-14 * _dot(y, y):
            past = [*past, (s, y)][-MEMORY:]
        point, losses, gradient = moved, new_losses, new_gradient
        history.append(losses)
    return point
