"""A perceptron of one hidden layer by L-BFGS: rows packed once, then one job a pass for the models of all folds.

The model, its objective and its steps are those of Spark's ML library: sigmoid hidden units, softmax, mean cross
entropy over stacks of 128 rows as they lie in a partition, ten corrections and a strong Wolfe line search. Rows lie
in memory as blocks of double arrays; a pass multiplies whole blocks and gives a gradient per partition and model
to the driver, some 26 KB each at 30 features and 100 units, from twice as many partitions as there are cores at most.
"""

from __future__ import annotations

import math
from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from faultline.session import stage

STACK = 128
#: Rows of a block, and of what is computed at a time: multiples of the stack.
BLOCK_ROWS, RUN_ROWS = 16 * STACK, 4 * STACK
#: Training rows that are worth a task of their own.
TASK_ROWS = 4_000
CORRECTIONS = 10
TOLERANCE = 1e-6
_TARGETS = np.eye(2)
_BLOCK = "cell int, part int, at int, n int, y binary, x binary"

#: A search asks for the objective at a point and is sent its value and gradient there; it returns the last point.
Search = Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]


# ---- the objective -------------------------------------------------------------------------------


def blocks(train: DataFrame, cell: Column, features: list[str]) -> DataFrame:
    """(cell, part, at, n, y, x): the rows in blocks, in the order and the stacks in which they lie in a partition."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, done = TaskContext.get().partitionId(), {}, {}

        def block(c: int, rows: np.ndarray) -> pa.RecordBatch:
            if not np.isfinite(rows).all():
                raise ValueError("a training row holds a null or a number that is not finite")
            done[c] = done.get(c, -1) + 1
            y, x = rows[:, 0].astype(np.int8).tobytes(), np.column_stack([rows[:, 1:], np.ones(len(rows))]).tobytes()
            values = zip(_BLOCK.split(", "), (c, part, done[c], len(rows), y, x))
            types = {"int": pa.int32(), "binary": pa.binary()}
            return pa.record_batch({k.split()[0]: pa.array([v], types[k.split()[1]]) for k, v in values})

        for batch in batches:
            cells = batch.column(0).to_numpy()
            rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:]])
            for c in np.unique(cells).tolist():
                own = np.concatenate([*held.pop(c, []), rows[cells == c]])
                full = len(own) - len(own) % BLOCK_ROWS
                for i in range(0, full, BLOCK_ROWS):
                    yield block(c, own[i : i + BLOCK_ROWS])
                if full < len(own):
                    held[c] = [own[full:]]
        for c, (rows,) in held.items():
            yield block(c, rows)

    return train.select(cell.alias("cell"), "label", *features).mapInArrow(pack, _BLOCK)


def sums(y: np.ndarray, x: np.ndarray, weights: np.ndarray, hidden: int) -> tuple[float, np.ndarray]:
    """Loss and gradient, summed over the stacks of a block; the last column of `x` is 1."""
    n, d = x.shape
    # Per layer, the weights of an input to all units lie together, then come the biases: those of the input 1.
    first, second = weights[: d * hidden].reshape(d, hidden), weights[d * hidden :].reshape(hidden + 1, 2)
    share = np.full(n, 1 / STACK)
    if n % STACK:
        share[n - n % STACK :] = 1 / (n % STACK)
    # Four stacks at a time, in arrays that are filled again: new ones would cost as much as what is done in them.
    units, back = np.empty((2, min(n, RUN_ROWS), hidden))
    loss, by_first, by_second, turned = 0.0, np.zeros_like(first), np.zeros_like(second), -first
    with np.errstate(all="ignore"):
        for i in range(0, n, RUN_ROWS):
            rows, part = x[i : i + RUN_ROWS], share[i : i + RUN_ROWS, None]
            u, v = units[: len(rows)], back[: len(rows)]
            np.matmul(rows, turned, out=u)
            np.exp(u, out=u)
            u += 1
            np.divide(1, u, out=u)
            out = u @ second[:-1] + second[-1]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            out /= out.sum(axis=1, keepdims=True)
            target = _TARGETS[y[i : i + RUN_ROWS]]
            loss -= (target * np.log(out) * part).sum()
            delta = (out - target) * part
            by_second[:-1] += u.T @ delta
            by_second[-1] += delta.sum(axis=0)
            np.matmul(delta, second[:-1].T, out=v)
            v *= u
            np.subtract(1, u, out=u)
            v *= u
            by_first += rows.T @ v
    return float(loss), np.concatenate([by_first.ravel(), by_second.ravel()])


def _pass(held: RDD, points: dict[int, np.ndarray], hidden: int) -> dict[int, tuple[float, np.ndarray]]:
    """The sums of every model that asks, in the order of partitions."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        found: dict[int, tuple[float, np.ndarray]] = {}
        for cell, n, y, x in rows:
            if cell in points:
                values = np.frombuffer(x).reshape(n, -1)
                loss, gradient = sums(np.frombuffer(y, np.int8), values, points[cell], hidden)
                before = found.get(cell, (0.0, 0.0))
                found[cell] = (before[0] + loss, before[1] + gradient)
        for cell, (loss, gradient) in found.items():
            yield cell, loss, gradient.tobytes()

    out: dict[int, tuple[float, np.ndarray]] = {}
    for cell, loss, gradient in held.mapPartitions(run).collect():
        before = out.get(cell, (0.0, 0.0))
        out[cell] = (before[0] + loss, before[1] + np.frombuffer(gradient))
    return out


# ---- the search ----------------------------------------------------------------------------------


class _Failed(Exception):
    """The line search or the history gives no further step."""


def _direction(gradient: np.ndarray, history: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Downhill by the last corrections, the newest first."""
    out, shares = gradient.copy(), []
    for step, change in history:
        shares.append(step @ out / (step @ change) if step @ change else math.nan)
        if math.isnan(shares[-1]):
            raise _Failed
        out -= shares[-1] * change
    if history:
        step, change = history[0]
        if not step @ change >= 0:
            raise _Failed
        out *= step @ change / (change @ change)
    for (step, change), share in zip(reversed(history), reversed(shares)):
        out += (share - change @ out / (step @ change)) * step
    return -out


def _between(left: tuple, right: tuple) -> float:
    """Minimum of the cubic through two points (t, value, slope), kept a tenth away from both."""
    (a, fa, da), (b, fb, db) = left, right
    d1 = da + db - 3 * (fa - fb) / (a - b)
    inner = d1 * d1 - da * db
    d2 = math.sqrt(inner) if inner >= 0 else math.nan
    under = db - da + 2 * d2
    t = b - (b - a) * (db + d2 - d1) / under if under else math.nan
    low, high = a + 0.1 * (b - a), a + 0.9 * (b - a)
    return low if t < low else high if t > high else t


def _line_search(x: np.ndarray, value: float, gradient: np.ndarray, along: np.ndarray, t: float):
    """(t, value, gradient) at a point that meets the strong Wolfe conditions."""
    slope = gradient @ along
    if slope > 0:
        raise _Failed

    def at(t: float):
        found, there = yield x + along * t
        return (t, found, there @ along), there

    def zoom(low: tuple, high: tuple):
        for _ in range(10):
            c, there = yield from at(_between(high, low) if low[0] > high[0] else _between(low, high))
            if c[1] > value + 1e-4 * c[0] * slope or c[1] >= low[1]:
                high = c
                continue
            if abs(c[2]) <= 0.9 * abs(slope):
                return c[0], c[1], there
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        raise _Failed

    low = (0.0, value, slope)
    for i in range(10):
        c, there = yield from at(t)
        if not math.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > value + 1e-4 * t * slope or (c[1] >= low[1] and i > 0):
            return (yield from zoom(low, c))
        if abs(c[2]) <= 0.9 * abs(slope):
            return c[0], c[1], there
        if c[2] >= 0:
            return (yield from zoom(c, low))
        low = c
        t *= 1.5
    raise _Failed


def minimise(x: np.ndarray, steps: int, tolerance: float = TOLERANCE) -> Search:
    """The last point of at most `steps` steps; ends when the value hardly falls over twenty, or the gradient is flat."""
    value, gradient = yield x
    start, recent, history, failed, done = value, [math.inf], [], False, 0
    while done < steps:
        still = len(recent) >= 2 and abs(value - max(recent)) <= tolerance * start
        if still or np.linalg.norm(gradient) <= max(tolerance * abs(value), 1e-8):
            break
        try:
            along = _direction(gradient, history)
            length = 1.0 if done else 1 / np.linalg.norm(along)
            t, found, there = yield from _line_search(x, value, gradient, along, length)
            if t * np.linalg.norm(gradient) < 1e-10:
                raise _Failed
        except _Failed:
            if failed:
                break
            failed, history = True, []
            continue
        step = along * t
        history = [(step, there - gradient), *history][:CORRECTIONS]
        x, value, gradient, failed, done = x + step, found, there, False, done + 1
        recent = [*recent, value][-20:]
    return x


def fit(
    train: DataFrame, cell: Column, features: list[str], hidden: int, steps: int, start: dict[int, np.ndarray]
) -> dict[int, np.ndarray]:
    """The weights of the model of every cell in `start` that has training rows; `start` holds their first weights."""
    packed = stage(blocks(train.where(cell.isNotNull()), cell, features))
    sizes = packed.groupBy("cell").agg(F.sum("n").alias("n"), F.sum(F.ceil(F.col("n") / STACK)).alias("stacks"))
    sizes = {r["cell"]: (r["n"], r["stacks"]) for r in sizes.collect()}
    tasks = min(2 * train.sparkSession.sparkContext.defaultParallelism, sum(n for n, _ in sizes.values()) // TASK_ROWS)
    dealt = packed.repartition(max(1, tasks), "cell", "part", "at").sortWithinPartitions("cell", "part", "at")
    held = dealt.select("cell", "n", "y", "x").rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
    searches, asked, found = {c: minimise(start[c], steps) for c in sizes}, {}, {}
    try:
        asked = {c: next(search) for c, search in searches.items()}
        while asked:
            for c, (loss, gradient) in _pass(held, asked, hidden).items():
                stacks = sizes[c][1]
                try:
                    asked[c] = searches[c].send((loss / stacks, gradient / stacks))
                except StopIteration as end:
                    found[c] = end.value
                    del asked[c]
    finally:
        held.unpersist()
    return found
