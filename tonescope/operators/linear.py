"""Linear heads over sparse rows, fitted by quasi-Newton steps: executors add the gradients of rows that are stored once.

The driver holds weights and a few past steps, whose size is that of the vocabulary and not of the data.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches, stored, trimmed

#: Rows or entries of a task of a step at least, whichever makes more tasks, and numbers in a piece of a gradient on its way.
TASK_ROWS, TASK_ENTRIES, PIECE = 20_000, 1_000_000, 1 << 16
#: Entries of sparse rows that a task works on at a time.
ENTRIES = 1 << 19
#: Bytes of all tasks' gradients that the driver adds up itself; more are added up by executors first.
DIRECT = 64 << 20
#: Sparse rows some at a time, as bytes of whole arrays: each step reads them again, and lists would be read entry by entry.
BLOCKS = "n long, entries long, idx binary, val binary, ends binary, targets binary"
#: Blocks of a row group, which a task reads at once.
GROUP = {"parquet.block.row.count.limit": 8}


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def logistic(z: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy of a logit against a share, and its slope."""
    return np.logaddexp(0, z) - t * z, sigmoid(z) - t


def squared(z: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (z - t) ** 2, 2 * (z - t)


def tempered(temperature: float) -> Callable:
    """Divergence of a student's logit from a teacher's, both softened by a temperature."""

    def loss(z: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, soft = sigmoid(t / temperature), z / temperature
        own = np.logaddexp(0, t / temperature) - p * t / temperature
        return np.logaddexp(0, soft) - p * soft - own, (sigmoid(soft) - p) / temperature

    return loss


def scores(idx: np.ndarray, val: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of sparse rows that end at ``ends`` (from a leading 0 on): a score for each head; the last weight is the intercept."""
    there = np.diff(ends) > 0
    begins, out = ends[:-1][there], np.zeros((len(ends) - 1, len(weights)))
    for k, w in enumerate(weights):
        if len(begins):
            out[there, k] = np.add.reduceat(val * w[idx], begins)
        out[:, k] += w[-1]
    return out


def sparse_parts(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    ends = column.offsets.to_numpy()
    return column.flatten().to_numpy(), ends - ends[0]


def block(idx: np.ndarray, val: np.ndarray, ends: np.ndarray, targets: np.ndarray) -> pa.RecordBatch:
    """A row of BLOCKS: sparse rows that end at ``ends`` (from a leading 0 on), and their targets (rows, heads)."""
    parts = [np.ascontiguousarray(x, t).tobytes() for x, t in ((idx, np.int32), (val, np.float64 if val.dtype == np.float64 else np.float32), (ends, np.int64), (targets, np.float64))]
    return pa.RecordBatch.from_arrays([pa.array([len(ends) - 1], pa.int64()), pa.array([len(idx)], pa.int64()), *[pa.array([x], pa.binary()) for x in parts]], ["n", "entries", "idx", "val", "ends", "targets"])


def unpacked(b: pa.RecordBatch):
    """(idx, val, ends, targets as one row of numbers) of each of a batch's blocks; values are as wide as they were."""
    for n, *parts in zip(b.column(1).to_pylist(), *[b.column(i) for i in range(2, 6)]):
        idx, val, ends, targets = (x.as_buffer() for x in parts)
        yield np.frombuffer(idx, np.int32), np.frombuffer(val, np.float64 if n and val.size == 8 * n else np.float32), np.frombuffer(ends, np.int64), np.frombuffer(targets)


def packed(rows: DataFrame) -> DataFrame:
    """Rows of idx, val, targets as BLOCKS, stored."""

    def task(batches):
        for b in batches:
            (idx, ends), (val, _), (targets, _) = (sparse_parts(b.column(i)) for i in range(3))
            targets = targets.reshape(len(ends) - 1, -1)
            for begin, end in _row_ranges(ends):
                mine = slice(ends[begin], ends[end])
                yield block(idx[mine], val[mine], ends[begin : end + 1] - ends[begin], targets[begin:end])

    small_batches(rows.sparkSession)
    return stored(rows.select("idx", "val", "targets").mapInArrow(trimmed(task), BLOCKS), **GROUP)


def _row_ranges(ends: np.ndarray):
    """Ranges of rows that hold about so many entries, one row at least."""
    begin = 0
    while begin < len(ends) - 1:
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + ENTRIES, side="right")) - 1)
        yield begin, end
        begin = end


def _gradient(rows: DataFrame, weights: np.ndarray, losses: list[Callable], reduce_by: int) -> tuple[float, np.ndarray]:
    """Sums over all rows of BLOCKS of losses and of their slopes; a target that is not finite adds nothing. reduce_by:
    executors add up tasks' gradients first if it is over 1."""
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast(weights)
    size = weights.size

    def task(batches):
        w = shared.value
        total, out = 0.0, np.zeros(w.shape)
        for idx, val, ends, targets in chain.from_iterable(map(unpacked, batches)):
            targets = targets.reshape(-1, len(losses))
            for begin, end in _row_ranges(ends):  # some entries at a time, so that a block of long rows takes no more memory
                mine = slice(ends[begin], ends[end])
                x, v, upto = idx[mine], val[mine], ends[begin : end + 1] - ends[begin]
                z = scores(x, v, upto, w)
                for k, loss in enumerate(losses):
                    t = targets[begin:end, k]
                    there = np.isfinite(t)
                    value, slope = loss(z[:, k], np.where(there, t, 0.0))
                    slope = np.where(there, slope, 0.0)
                    total += float(value[there].sum())
                    np.add.at(out[k], x, v * np.repeat(slope, np.diff(upto)))
                    out[k, -1] += slope.sum()
        flat = np.concatenate([out.ravel(), [total]])
        yield from pieces((i, flat[i * PIECE : (i + 1) * PIECE]) for i in range(-(-len(flat) // PIECE)))

    def pieces(parts):
        parts = list(parts)
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([x.tobytes() for _, x in parts], pa.binary())], ["piece", "part"])

    def added(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(x)
                sums[i] = sums[i] + x if i in sums else x
        if sums:
            yield from pieces(sorted(sums.items()))

    found = rows.mapInArrow(task, "piece int, part binary")
    if reduce_by > 1:
        found = found.repartition(min(reduce_by, size // PIECE + 1), "piece").mapInArrow(added, "piece int, part binary")
    parts: dict[int, np.ndarray] = {}
    for b in found.toArrow().to_batches():  # a gradient's pieces, each once if they were added up, else DIRECT bytes at most
        for i, x in zip(b.column(0).to_pylist(), b.column(1)):
            x = np.frombuffer(x.as_buffer())
            parts[i] = parts[i] + x if i in parts else x
    shared.destroy()
    flat = np.concatenate([parts[i] for i in sorted(parts)]) if parts else np.zeros(size + 1)
    return float(flat[-1]), flat[:-1].reshape(weights.shape)


def quasi_newton(objective: Callable, start: np.ndarray, iterations: int, tolerance: float, memory: int = 20) -> tuple[np.ndarray, int]:
    """The least point of a smooth convex objective (value and gradient of a point): limited-memory BFGS with halved steps,
    until no gradient entry is over the tolerance, times the start's largest where that is over 1. Also the steps taken."""
    x = start
    value, grad = objective(x)
    least = tolerance * max(1.0, np.abs(grad).max(initial=0.0))
    past: deque = deque(maxlen=memory)
    for step in range(iterations):
        if np.abs(grad).max(initial=0.0) <= least:
            return x, step
        way, kept = -grad, []
        for s, y, rho in reversed(past):
            a = rho * np.vdot(s, way)
            kept.append(a)
            way = way - a * y
        if past:
            s, y, rho = past[-1]
            way = way / (rho * np.vdot(y, y))
        for (s, y, rho), a in zip(past, reversed(kept)):
            way = way + (a - rho * np.vdot(y, way)) * s
        slope = float(np.vdot(grad, way))
        length = 1.0 if past else min(1.0, 1.0 / np.abs(grad).sum())
        while True:
            new = x + length * way
            new_value, new_grad = objective(new)
            if new_value <= value + 1e-4 * length * slope or length < 1e-12:
                break
            length /= 2
        if not new_value < value:  # as near as numbers are
            return x, step
        s, y = new - x, new_grad - grad
        if (sy := float(np.vdot(s, y))) > 1e-300:
            past.append((s, y, 1.0 / sy))
        x, value, grad = new, new_value, new_grad
    return x, iterations


def fit_heads(rows: DataFrame, n_features: int, losses: list[Callable], penalty: float, iterations: int = 2000, tolerance: float = 1e-6) -> np.ndarray:
    """Weights (heads, features + 1), intercepts last: the least mean loss plus half the penalty times the squared weights
    (intercepts are free), until no entry of the gradient is over the tolerance. rows: idx, val, targets, or a stored table of BLOCKS.
    """
    rows = rows if "entries" in rows.columns else packed(rows)
    n, entries = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("entries"), F.lit(0))).first()
    if not n:
        return np.zeros((len(losses), n_features + 1))
    tasks = max(1, min(rows.rdd.getNumPartitions(), math.ceil(max(n / TASK_ROWS, entries / TASK_ENTRIES))))
    rows = rows.coalesce(tasks)
    reduce_by = tasks if 8 * tasks * len(losses) * (n_features + 1) > DIRECT else 1

    def objective(w: np.ndarray) -> tuple[float, np.ndarray]:
        total, grad = _gradient(rows, w, losses, reduce_by)
        held = w.copy()
        held[:, -1] = 0
        return total / n + penalty / 2 * float(np.vdot(held, held)), grad / n + penalty * held

    return quasi_newton(objective, np.zeros((len(losses), n_features + 1)), iterations, tolerance)[0]
