"""Logistic regression of several fits in the same passes.

All fits of a cross-validation see the same rows but for one fold each. A pass sums the
loss and gradient of every fit at its own point over binned-free blocks of rows; each fit
takes its own limited-memory BFGS steps on the driver and drops out once it has converged.
The loss is that of ``pyspark.ml``: the weighted mean of the log loss, plus half the squared
weights (not the intercepts) times ``penalty``, on unscaled columns; inside, columns are
scaled so that few steps do.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import quoted
from .packed import blocks, matrix, summed

HISTORY = 10
TOLERANCE = 1e-9  # relative change of the loss at which a fit has converged
_ROWS = "n bigint, x binary, label binary, fold binary"


@dataclass
class Logistic:
    """Weights (feature, output) and intercepts; two classes share one output."""

    classes: int
    weights: np.ndarray
    intercepts: np.ndarray

    def probabilities(self, values: np.ndarray) -> np.ndarray:
        return _softmax(np.nan_to_num(values) @ self.weights + self.intercepts)


def _softmax(z: np.ndarray) -> np.ndarray:
    if z.shape[1] == 1:
        one = 1 / (1 + np.exp(-z))
        return np.concatenate([1 - one, one], axis=1)
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class _Fit:
    """One fit's place in its descent. ``ask`` is the next point whose loss it wants to know."""

    ask: np.ndarray
    at: np.ndarray | None = None
    loss: float = np.inf
    grad: np.ndarray | None = None
    way: np.ndarray | None = None
    length: float = 1.0
    steps: list = field(default_factory=list)
    done: bool = False
    taken: int = 0

    def told(self, loss: float, grad: np.ndarray, most: int) -> None:
        if self.at is not None:
            if loss > self.loss + 1e-4 * self.length * float(self.grad @ self.way):  # too far: half the way
                self.length /= 2
                self.ask = self.at + self.length * self.way
                self.done = self.length < 1e-12
                return
            s, y = self.ask - self.at, grad - self.grad
            if float(s @ y) > 1e-300:
                self.steps = [*self.steps, (s, y)][-HISTORY:]
            self.done = abs(self.loss - loss) <= TOLERANCE * max(abs(loss), 1e-300)
        self.at, self.loss, self.grad, self.taken = self.ask, loss, grad, self.taken + 1
        self.done |= self.taken > most or float(np.abs(grad).max()) < 1e-12
        self.way, self.length = self._direction(), 1.0 if self.steps else min(1.0, 1 / max(float(np.linalg.norm(grad)), 1e-300))
        self.ask = self.at + self.length * self.way

    def _direction(self) -> np.ndarray:
        q, used = -self.grad.copy(), []
        for s, y in reversed(self.steps):
            a = float(s @ q) / float(s @ y)
            q -= a * y
            used.append(a)
        if self.steps:
            s, y = self.steps[-1]
            q *= float(s @ y) / float(y @ y)
        for (s, y), a in zip(self.steps, reversed(used)):
            q += s * (a - float(y @ q) / float(s @ y))
        return q


def fit_logistic(
    df: DataFrame, columns: Sequence[str], classes: int, sizes: np.ndarray, balanced: bool, iterations: int, folds: int = 0
) -> list[Logistic]:
    """Models on the number ``columns`` and ``label``; with ``folds`` one for each ``fold``,
    fitted to all others. ``sizes`` has the rows by (fit, label). The penalty is one over a
    fit's rows; ``balanced`` weighs each class to the same total."""
    columns, fits = list(columns), len(sizes)
    width, outputs = len(columns), 1 if classes == 2 else classes
    rows = (df if folds else df.withColumn("fold", F.lit(-1))).select(*[quoted(c) for c in columns], "label", "fold")
    moments = rows.agg(*[f(quoted(c)) for c in columns for f in (F.avg, F.stddev_pop)]).first()
    mean, spread = (np.array([moments[2 * j + k] or 0.0 for j in range(width)]) for k in (0, 1))
    scale = np.where(spread > 0, spread, 1.0)
    counts = np.maximum(sizes.sum(axis=1), 1)
    present = (sizes > 0).sum(axis=1, keepdims=True)
    weights = np.where(sizes > 0, counts[:, None] / np.maximum(present * sizes, 1), 0.0) if balanced else np.ones_like(sizes)
    totals = np.maximum((weights * sizes).sum(axis=1), 1e-300)

    def pack(batch: pa.RecordBatch) -> dict:
        x = (np.nan_to_num(matrix(batch, columns)) - mean) / scale
        whole = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int32) for c in ("label", "fold")}
        return {"n": batch.num_rows, "x": x, **whole}

    state = blocks(rows, _ROWS, pack).persist(StorageLevel.MEMORY_AND_DISK)
    tasks = state.rdd.getNumPartitions()
    size = (width + 1) * outputs
    running = [_Fit(np.zeros(size)) for _ in range(fits)]

    def losses(points: dict[int, np.ndarray]):
        def add(row: dict, totals_of: dict) -> None:
            x = np.frombuffer(row["x"]).reshape(row["n"], width)
            label, fold = np.frombuffer(row["label"], np.int32), np.frombuffer(row["fold"], np.int32)
            for k, point in points.items():
                inside = fold != k
                xs, ys = x[inside], label[inside]
                w = point.reshape(width + 1, outputs)
                p, weight = _softmax(xs @ w[:-1] + w[-1]), weights[k][ys]
                lost = -np.log(np.maximum(p[np.arange(len(ys)), ys], 1e-300)) * weight
                off = (p[:, 1:] - (ys == 1)[:, None]) if outputs == 1 else p - (ys[:, None] == np.arange(classes))
                off = off * weight[:, None]
                total = totals_of.setdefault((k, 0), np.zeros(size + 1))
                total[0] += lost.sum()
                total[1:] += np.concatenate([xs.T @ off, off.sum(axis=0, keepdims=True)]).ravel()

        return add

    while active := {k: f.ask for k, f in enumerate(running) if not f.done}:
        found = summed(state, tasks, losses(active), (size + 1,), len(active))
        for k, point in active.items():
            total = found.get((k, 0), np.zeros(size + 1)) / totals[k]
            w = np.concatenate([point.reshape(width + 1, outputs)[:-1] / scale[:, None] ** 2, np.zeros((1, outputs))]).ravel()
            running[k].told(total[0] + float(point @ w) / (2 * counts[k]), total[1:] + w / counts[k], iterations)
    state.unpersist()
    out = []
    for f in running:
        w = f.at.reshape(width + 1, outputs)
        plain = w[:-1] / scale[:, None]
        out.append(Logistic(classes, plain, w[-1] - mean @ plain))
    return out
