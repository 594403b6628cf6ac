"""Gradients of a layered network over a table, and descent along them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import share_package

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]
BLOCK = 128  #: rows that count as one in a mean, as in Spark's fits; the last block of a partition may be shorter
ROWS = 4 * BLOCK  #: rows multiplied at once


def packed(df: DataFrame, size: int, classes: int) -> RDD:
    """Vectors and labels of ``ROWS`` rows at a time, in the order of the table and spread evenly over the cores; kept until unpersisted."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, at = np.empty((0, size)), np.empty(0, np.int64), 0

        def cut(n: int) -> pa.RecordBatch:
            nonlocal x, y, at
            out = {"part": [TaskContext.get().partitionId()], "at": [at], "x": [x[:n].tobytes()], "y": [y[:n].tobytes()]}
            x, y, at = x[n:], y[n:], at + 1
            return pa.RecordBatch.from_pydict(out)

        for b in batches:
            vectors = b.column(0).cast(pa.list_(pa.float64(), size)).flatten().to_numpy(zero_copy_only=False)
            labels = b.column(1).to_numpy(zero_copy_only=False)
            if len(vectors) != size * len(labels) or not np.isfinite(vectors).all() or not ((labels >= 0) & (labels < classes) & (labels % 1 == 0)).all():
                raise ValueError("vectors must be whole and finite, and labels 0, 1, 2, ...")
            x, y = np.concatenate([x, vectors.reshape(-1, size)]), np.concatenate([y, labels.astype(np.int64)])
            while len(y) >= ROWS:
                yield cut(ROWS)
        if len(y):
            yield cut(len(y))

    share_package(df.sparkSession)
    rows = df.select(F.col("embedding").cast("array<double>"), F.col("label").cast("double")).mapInArrow(pack, "part long, at long, x binary, y binary")
    even = rows.repartition(df.sparkSession.sparkContext.defaultParallelism).sortWithinPartitions("part", "at")  # in order, so that sums repeat
    return even.rdd.map(lambda r: (np.frombuffer(r.x).reshape(-1, size), np.frombuffer(r.y, np.int64))).persist(StorageLevel.MEMORY_AND_DISK)


def gradient(weights: np.ndarray, layers: list[int], x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean cross entropy of each block of rows and its gradient, summed over the blocks. Sigmoids between the layers, softmax
    after the last; weights as in Spark's model: of each layer a row for each input, then the offsets."""
    parts, at = [], 0
    for i, o in zip(layers, layers[1:]):
        parts.append((weights[at : at + i * o].reshape(i, o), weights[at + i * o : at + i * o + o]))
        at += i * o + o
    outs = [x]
    with np.errstate(over="ignore"):
        for w, b in parts[:-1]:
            z = outs[-1] @ w
            z += b
            np.exp(np.negative(z, out=z), out=z)
            z += 1
            outs.append(np.reciprocal(z, out=z))
    z = outs[-1] @ parts[-1][0] + parts[-1][1]
    z -= z.max(axis=1, keepdims=True)
    delta, at = np.exp(z), np.arange(len(y))
    total = delta.sum(axis=1, keepdims=True)
    share = 1 / np.minimum(len(y) - at // BLOCK * BLOCK, BLOCK)
    loss = float((share * (np.log(total[:, 0]) - z[at, y])).sum())
    delta /= total
    delta[at, y] -= 1
    delta *= share[:, None]
    grads: list[np.ndarray] = []
    for k in range(len(parts) - 1, -1, -1):
        grads[:0] = [(outs[k].T @ delta).ravel(), delta.sum(axis=0)]
        if k:
            delta = delta @ parts[k][0].T
            delta *= outs[k]
            delta *= np.subtract(1, outs[k], out=outs[k])
    return loss, np.concatenate(grads)


def objective(blocks: RDD, layers: list[int]) -> Objective:
    """Mean cross entropy over the blocks of ``packed`` and its gradient; each task sends one sum, and there are as many as cores."""

    def mean(weights: np.ndarray) -> tuple[float, np.ndarray]:
        def add(rows: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, float, np.ndarray]]:
            n, loss, grad = 0, 0.0, np.zeros(len(weights))
            for x, y in rows:
                part = gradient(weights, layers, x, y)
                n, loss = n - len(y) // -BLOCK, loss + part[0]
                grad += part[1]
            yield n, loss, grad

        sums = blocks.mapPartitions(add).collect()
        n = sum(s[0] for s in sums)
        return sum(s[1] for s in sums) / n, sum(s[2] for s in sums) / n

    return mean


def _direction(grad: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out, kept = grad.copy(), []
    for step, change in reversed(pairs):
        rho = step @ change
        kept.append((step, change, rho, step @ out / rho))
        out -= kept[-1][3] * change
    if pairs:
        out *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1])
    for step, change, rho, a in reversed(kept):
        out += (a - change @ out / rho) * step
    return -out


def _between(a: tuple, b: tuple) -> float:
    """The least point of the cubic through two (t, value, slope), not too near to either."""
    (lt, lv, ls), (rt, rv, rs) = sorted((a, b))
    d = ls + rs - 3 * (lv - rv) / (lt - rt)
    root = np.sqrt(d * d - ls * rs)
    t = rt - (rt - lt) * (rs + root - d) / (rs - ls + 2 * root)
    return float(min(max(t, lt + 0.1 * (rt - lt)), lt + 0.9 * (rt - lt)))


def _step(f: Objective, x: np.ndarray, value: float, slope: float, way: np.ndarray, t: float) -> tuple[float, np.ndarray, float, np.ndarray] | None:
    """A step (t, x, value, gradient) along ``way`` that meets the strong Wolfe conditions; None if ten tries and ten halvings find none."""
    low, high = (0.0, value, slope), None
    for _ in range(10):
        at = x + t * way
        v, g = f(at)
        if not np.isfinite(v):
            t /= 2
            continue
        c = (t, v, float(g @ way))
        if v > value + 1e-4 * t * slope or (v >= low[1] and low[0] > 0):
            high = c
            break
        if abs(c[2]) <= 0.9 * abs(slope):
            return t, at, v, g
        if c[2] >= 0:
            low, high = c, low
            break
        low, t = c, t * 1.5
    for _ in range(10 if high else 0):
        t = _between(low, high)
        at = x + t * way
        v, g = f(at)
        c = (t, v, float(g @ way))
        if v > value + 1e-4 * t * slope or v >= low[1]:
            high = c
            continue
        if abs(c[2]) <= 0.9 * abs(slope):
            return t, at, v, g
        high, low = (low if c[2] * (high[0] - low[0]) >= 0 else high), c
    return None


def descend(f: Objective, x: np.ndarray, tol: float = 1e-6, memory: int = 10) -> Iterator[np.ndarray]:
    """The points after each step of L-BFGS from ``x``, with the steps and the end of Spark's own fits, whose runs of more
    iterations only repeat and go on from those of fewer."""
    value, grad = f(x)
    start, values, pairs, count = value, [], [], 0
    while np.linalg.norm(grad) > max(tol * value, 1e-8):
        way = _direction(grad, pairs)
        slope = float(grad @ way)
        step = _step(f, x, value, slope, way, 1.0 if count else 1 / np.linalg.norm(way)) if slope <= 0 else None
        if step is None or step[0] * np.linalg.norm(grad) < 1e-10:
            if not pairs:
                return
            pairs = []  # once more along the gradient itself
            continue
        pairs = [*pairs, (step[1] - x, step[3] - grad)][-memory:]
        if not pairs[-1][0] @ pairs[-1][1] > 0:
            pairs = []
        _, x, value, grad = step
        count, values = count + 1, [*values, value][-20:]
        yield x
        if count >= 20 and abs(value - max(values)) <= tol * start:
            return
