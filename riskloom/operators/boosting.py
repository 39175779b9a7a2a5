"""Gradient boosting on one joint loss: softmax over all classes, K trees a round (Friedman 2001).

Rows lie in binned blocks that also hold their scores. A round fits one regression tree a
class to the residuals ``label - probability``; a level of all its trees is one pass that
sums residual histograms over the tasks. Leaves take a Newton step. Two classes share one
score and one tree a round. Cross-validation fits all folds in the same passes: a block
holds a score for each fit, and a row adds nothing to the fit that leaves its fold out.

Rows of the same bins, label and fold are one row to every tree, with the same scores. Where
the table has many rows for each such cell that its columns allow, the cells with their
numbers of rows are fitted in place of the rows: the passes then cost what the cells do.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, HasMaxIter, HasStepSize
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import quoted
from ..session import scratch, write_out
from .ordering import spread
from .packed import binned, blocks, fold_sizes, held_out, matrix, summed, thresholds

CUT_ROUNDS = 10  # rounds between two written copies of the scores, which keep lineage short
CELL_ROWS = 4  # rows for each possible cell from which on cells are fitted in place of rows
_STATE = "n bigint, bins binary, label binary, fold binary, times binary, scores binary"


@dataclass
class Boosted:
    """A fitted model. Trees are complete and stored in heap order; a node that isn't split
    has feature -1 and sends every row to its left. ``leaf`` includes the learning rate.
    ``one_hot`` has the number of codes of each column that stands for as many 0/1 columns, and
    0 for numbers; a node on such a column sends one code to its left."""

    classes: int
    start: list[float]
    feature: list[list[list[int]]]
    cut: list[list[list[float]]]
    leaf: list[list[list[float]]]
    one_hot: list[int] = field(default_factory=list)

    def scores(self, values: np.ndarray) -> np.ndarray:
        out = np.tile(np.array(self.start), (len(values), 1))
        for features, cuts, leaves in zip(self.feature, self.cut, self.leaf):
            for s in range(out.shape[1]):
                node = _leaf_of(values, np.array(features[s]), np.array(cuts[s]), one_hot=self.one_hot)
                out[:, s] += np.array(leaves[s])[node]
        return out

    def probabilities(self, values: np.ndarray) -> np.ndarray:
        return _probabilities(self.scores(values))

    def predict(self, values: np.ndarray) -> np.ndarray:
        return self.probabilities(values).argmax(axis=1) if len(values) else np.empty(0, int)


def _leaf_of(values: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int | None = None, one_hot: Sequence[int] = ()) -> np.ndarray:
    """Where each row ends among the nodes ``levels`` below the root (all levels by default)."""
    levels = (len(feature) + 1).bit_length() - 1 if levels is None else levels
    node, row, coded = np.zeros(len(values), np.int64), np.arange(len(values)), np.array(one_hot or [0]) > 0
    for _ in range(levels):
        f = feature[node]
        value, at = values[row, np.maximum(f, 0)], cut[node]
        left = np.where(coded[np.maximum(f, 0)], value == at, value <= at) if coded.any() else value <= at
        right = (f >= 0) & ~left
        node = 2 * node + 1 + right
    return node - (2**levels - 1)


def _probabilities(scores: np.ndarray) -> np.ndarray:
    if scores.shape[-1] == 1:
        one = 1 / (1 + np.exp(-scores))
        return np.concatenate([1 - one, one], axis=-1)
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _residuals(scores: np.ndarray, label: np.ndarray, classes: int) -> np.ndarray:
    """Label minus probability, for each score."""
    p = _probabilities(scores)
    if scores.shape[-1] == 1:
        return (label == 1)[:, None] - p[:, 1:]
    return (label[:, None] == np.arange(classes)) - p


@dataclass(frozen=True)
class _Cells:
    """The cells of a node's histogram: the bins of all columns, one column after another. The
    last bin of a column can't be split off: of numbers it is all that is left, of codes it
    is the rows without one."""

    starts: np.ndarray
    column: np.ndarray
    coded: np.ndarray
    last: np.ndarray

    @staticmethod
    def of(bins: Sequence[int], one_hot: Sequence[int]) -> _Cells:
        starts = np.concatenate([[0], np.cumsum(bins)]).astype(np.int64)
        column = np.repeat(np.arange(len(bins)), bins)
        last = np.zeros(len(column), bool)
        last[starts[1:] - 1] = True
        return _Cells(starts, column, np.array(one_hot)[column] > 0, last)


def best_splits(hist: np.ndarray, cells: _Cells) -> list[tuple[int, int, np.ndarray, np.ndarray] | None]:
    """Per node of (node, cell, [sum, curvature, count]): (column, bin, left, right) of the split
    that lowers the squared error most, the first of (nearly) equals; None where none does."""
    out = []
    for node in hist:
        whole = node[cells.starts[0] : cells.starts[1]].sum(axis=0)
        run = np.cumsum(node, axis=0)
        before = np.concatenate([np.zeros((1, 3)), run])[cells.starts[:-1]]
        left = np.where(cells.coded[:, None], node, run - before[cells.column])
        right = whole - left
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left[:, 0] ** 2 / left[:, 2] + right[:, 0] ** 2 / right[:, 2] - whole[0] ** 2 / whole[2]
        gain = np.where((left[:, 2] > 0) & (right[:, 2] > 0) & ~cells.last, gain, -np.inf)
        if not gain.size or not gain.max() > 1e-12 * max(1.0, whole[2]):
            out.append(None)
            continue
        k = int(gain.astype(np.float32).argmax())  # sums in another order don't change the choice
        f = int(cells.column[k])
        out.append((f, int(k - cells.starts[f]), left[k], right[k]))
    return out


def fit_boosting(
    df: DataFrame, columns: Sequence[str], classes: int, rounds: int, rate: float, depth: int, max_bins: int, folds: int = 0,
    cuts: Sequence[np.ndarray] | None = None, one_hot: Sequence[int] | None = None,
) -> list[Boosted]:
    """Models on the number ``columns`` and ``label`` (0, 1, ..); with ``folds`` one for each
    ``fold``, fitted to all other folds. ``cuts`` are the bins' thresholds, if already known.

    A column with a number of codes in ``one_hot`` holds codes from 0; any other value, as
    null, is no code. It is split as the 0/1 columns that it stands for would be.
    """
    columns, one_hot = list(columns), list(one_hot or [0] * len(columns))
    with scratch(df.sparkSession):
        if cuts is None:
            numbers = [c for c, n in zip(columns, one_hot) if not n]
            found = dict(zip(numbers, thresholds(df, numbers, max_bins) if numbers else []))
            cuts = [found.get(c, np.empty(0)) for c in columns]
        return _fitted(df, columns, classes, rounds, rate, depth, cuts, one_hot, folds)


def _fitted(df, columns, classes, rounds, rate, depth, cuts, one_hot, folds) -> list[Boosted]:
    fits, width = max(1, folds), len(columns)
    sizes_of = [n + 1 if n else len(c) + 1 for n, c in zip(one_hot, cuts)]
    cells, total = _Cells.of(sizes_of, one_hot), sum(sizes_of)
    kind = np.uint16 if max(sizes_of) < 1 << 16 else np.uint32
    outputs = 1 if classes == 2 else classes
    rows = df if folds else df.withColumn("fold", F.lit(-1))
    counted = fold_sizes(rows, classes) if folds else _class_sizes(rows, classes)
    sizes = held_out(counted, folds)
    share = np.clip(sizes / np.maximum(sizes.sum(axis=1, keepdims=True), 1), 1e-7, 1 - 1e-7)
    start = np.log(share[:, 1:] / share[:, :1]) if classes == 2 else np.log(share)
    # Where each fit's trees of this round stand; bin numbers in place of values.
    inner = 2**depth - 1

    def bins_of(values: np.ndarray) -> np.ndarray:
        out = binned(values, cuts).astype(kind)
        for j, n in enumerate(one_hot):
            if n:
                known = (values[:, j] >= 0) & (values[:, j] < n)
                out[:, j] = np.where(known, values[:, j], n)
        return out

    plain = rows.select(*[quoted(c) for c in columns], "label", "fold")
    shared = math.prod(sizes_of) * classes * fits * CELL_ROWS <= counted.sum()
    if shared:
        plain = _shared(plain, columns, bins_of, sizes_of)

    def pack(batch: pa.RecordBatch) -> dict:
        n = batch.num_rows
        scores = np.repeat(start[:, None, :], n, axis=1)
        if shared:
            bins = np.stack(np.unravel_index(batch.column("cell").to_numpy(), sizes_of), axis=1).astype(kind)
            times = batch.column("times").to_numpy().astype(float)
        else:
            bins, times = bins_of(matrix(batch, columns)), b""
        return {
            "n": n, "bins": bins, "times": times, "scores": scores,
            "label": batch.column("label").to_numpy(zero_copy_only=False).astype(np.int32),
            "fold": batch.column("fold").to_numpy(zero_copy_only=False).astype(np.int32),
        }

    state = blocks(plain, _STATE, pack).persist(StorageLevel.MEMORY_AND_DISK)
    tasks = state.rdd.getNumPartitions()
    before = None
    models = [Boosted(classes, s.tolist(), [], [], [], one_hot) for s in start]

    def opened(row: dict) -> tuple[np.ndarray, ...]:
        return (
            np.frombuffer(row["bins"], kind).reshape(row["n"], width), np.frombuffer(row["label"], np.int32),
            np.frombuffer(row["fold"], np.int32), np.frombuffer(row["scores"]).reshape(fits, row["n"], outputs),
            np.frombuffer(row["times"]) if shared else None,
        )

    def histograms(level: int, feature: np.ndarray, cut: np.ndarray):
        def add(row: dict, totals: dict) -> None:
            values, label, fold, scores, times = opened(row)
            for k in range(fits):
                inside = np.flatnonzero(fold != k)
                part, residual = values[inside], _residuals(scores[k][inside], label[inside], classes)
                for s in range(outputs):
                    if (k, s) not in totals:
                        totals[k, s] = np.zeros((2**level, total, 3))
                    r = residual[:, s]
                    weights = (r, np.abs(r) * (1 - np.abs(r)), None)
                    if shared:
                        weights = (weights[0] * times[inside], weights[1] * times[inside], times[inside])
                    node = _leaf_of(part, feature[k, s], cut[k, s], level, one_hot)
                    for j in range(width):
                        at = node * sizes_of[j] + part[:, j]
                        mine = totals[k, s][:, cells.starts[j] : cells.starts[j + 1]]
                        for w, weight in enumerate(weights):
                            mine[:, :, w] += np.bincount(at, weight, 2**level * sizes_of[j]).reshape(-1, sizes_of[j])

        return add

    for t in range(rounds):
        feature, cut = np.full((fits, outputs, inner), -1), np.zeros((fits, outputs, inner))
        values = np.zeros((fits, outputs, 2 * inner + 1, 3))
        for level in range(depth):
            found = summed(state, tasks, histograms(level, feature, cut), (2**level, total, 3), fits * outputs)
            if not found:
                break
            if before is not None:
                before.unpersist()
                before = None
            for (k, s), hist in found.items():
                if not level:
                    values[k, s, 0] = hist[0, : cells.starts[1]].sum(axis=0)
                for i, split in enumerate(best_splits(hist, cells)):
                    node = 2**level - 1 + i
                    if split:
                        feature[k, s, node], cut[k, s, node] = split[:2]
                        values[k, s, 2 * node + 1], values[k, s, 2 * node + 2] = split[2:]
                    else:
                        values[k, s, 2 * node + 1] = values[k, s, node]
        last = values[:, :, inner:]
        step = np.divide(last[..., 0], last[..., 1], out=np.zeros_like(last[..., 0]), where=last[..., 1] > 1e-150)
        leaf = rate * step * (1 if classes == 2 else (classes - 1) / classes)
        for k, model in enumerate(models):
            model.feature.append(feature[k].tolist())
            model.leaf.append(leaf[k].tolist())
            model.cut.append(
                [[0.0 if f < 0 else float(c) if one_hot[f] else float(cuts[f][int(c)]) for f, c in zip(feature[k, s].tolist(), cut[k, s].tolist())] for s in range(outputs)]
            )
        if t == rounds - 1:
            break

        def moved(batches: Iterator[pa.RecordBatch], feature=feature, cut=cut, leaf=leaf) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(batch.num_rows):
                    row = batch.slice(at, 1).to_pylist()[0]
                    part, _, _, scores, _ = opened(row)
                    scores = scores.copy()
                    for k in range(fits):
                        for s in range(outputs):
                            scores[k, :, s] += leaf[k, s][_leaf_of(part, feature[k, s], cut[k, s], one_hot=one_hot)]
                    yield pa.RecordBatch.from_pylist([row | {"scores": scores.tobytes()}], batch.schema)

        following = state.mapInArrow(moved, _STATE)
        if t % CUT_ROUNDS == CUT_ROUNDS - 1:
            following = write_out(following, "scores")
        before, state = state, following.persist(StorageLevel.MEMORY_AND_DISK)
    for held in (before, state):
        if held is not None:
            held.unpersist()
    return models


def _shared(rows: DataFrame, columns: Sequence[str], bins_of: Callable[[np.ndarray], np.ndarray], sizes: Sequence[int]) -> DataFrame:
    """(cell, label, fold, times): how many rows share their bins, label and fold. ``cell`` numbers the bins of all columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = bins_of(matrix(batch, columns)).astype(np.int64)
            cell = pa.array(np.ravel_multi_index(tuple(bins.T), sizes), pa.int64())
            whole = [batch.column(c).cast(pa.int32()) for c in ("label", "fold")]
            yield pa.RecordBatch.from_arrays([cell, *whole], ["cell", "label", "fold"])

    keys = ["cell", "label", "fold"]
    cells = rows.mapInArrow(run, "cell bigint, label int, fold int").groupBy(*keys).agg(F.count("*").alias("times"))
    cells = write_out(cells, "cells")
    return spread(cells, cells.count(), keys)


def _class_sizes(df: DataFrame, classes: int) -> np.ndarray:
    return fold_sizes(df.withColumn("fold", F.lit(0)), classes)


def scored(df: DataFrame, columns: Sequence[str], models: Sequence, by: str | None = None, probability: str | None = None) -> DataFrame:
    """Add ``prediction`` by numpy models; ``by`` names the column that says which of them."""
    columns = list(columns)

    def predict(*series: pd.Series) -> pd.DataFrame:
        values = np.stack([s.to_numpy(float) for s in series[: len(columns)]], axis=1)
        which = series[-1].to_numpy() if by else np.zeros(len(values), int)
        p = np.zeros((len(values), models[0].classes))
        for k in np.unique(which):
            p[which == k] = models[int(k)].probabilities(values[which == k])
        return pd.DataFrame({"prediction": p.argmax(axis=1).astype(float) if len(p) else [], "probability": list(p)})

    run = F.pandas_udf(predict, "prediction double, probability array<double>")
    inputs = [quoted(c).cast("double") for c in columns] + ([F.col(by)] if by else [])
    out = df.withColumn("_scored", run(*inputs)).withColumn("prediction", F.col("_scored.prediction"))
    if probability:
        out = out.withColumn(probability, F.col("_scored.probability"))
    return out.drop("_scored")


class _Settings(HasInputCols, HasLabelCol, HasMaxIter, HasStepSize):
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of a tree", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a column", TypeConverters.toInt)
    classes = Param(Params._dummy(), "classes", "number of labels", TypeConverters.toInt)
    oneHot = Param(Params._dummy(), "oneHot", "codes of each column, 0 for numbers", TypeConverters.toListInt)


class JointBoosting(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Boosting of all classes at once, as a stage of a pipeline."""

    @keyword_only
    def __init__(self, *, inputCols=None, labelCol="label", classes=2, maxIter=50, stepSize=0.1, maxDepth=3, maxBins=32, oneHot=None):
        super().__init__()
        self._setDefault(labelCol="label", oneHot=[], classes=2, maxIter=50, stepSize=0.1, maxDepth=3, maxBins=32)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "JointBoostingModel":
        get = self.getOrDefault
        rows = dataset.withColumn("label", F.col(get("labelCol")))
        made = fit_boosting(
            rows, get("inputCols"), get("classes"), get("maxIter"), get("stepSize"), get("maxDepth"), get("maxBins"), one_hot=get("oneHot") or None
        )[0]
        return JointBoostingModel(inputCols=get("inputCols"), fitted=json.dumps(made.__dict__))


class JointBoostingModel(Model, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    fitted = Param(Params._dummy(), "fitted", "the trees, as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=None, fitted=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @property
    def boosted(self) -> Boosted:
        return Boosted(**json.loads(self.getOrDefault("fitted")))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return scored(dataset, self.getInputCols(), [self.boosted], probability="probability")
