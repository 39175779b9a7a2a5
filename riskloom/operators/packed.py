"""Rows of an iterative fit as numpy blocks, and sums of arrays over all of them.

A fit that needs many passes over the same rows is dominated by how fast a task reads them.
Each block holds a few thousand rows as matrices, in partitions that follow from the row
count alone, so a pass is a handful of array operations a block. What a pass sums over the
rows (histograms, gradients) is summed a task first. Few and small sums go to the driver
as they are; more of them are added up key by key on the executors. Either way they are
added in the order of the partitions, so a re-run gives the same bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .quantiles import exact_quantiles

DIRECT_BYTES = 64 << 20  # sums of all tasks that the driver adds up itself


def thresholds(df: DataFrame, columns: Sequence[str], max_bins: int) -> list[np.ndarray]:
    """Per column the distinct quantiles that cut it into at most ``max_bins`` bins, the last
    (everything) left out. A value belongs to the first threshold that it doesn't exceed."""
    probs = [k / max_bins for k in range(1, max_bins + 1)]
    found = {r["column_name"]: r["q"] for r in exact_quantiles(df, columns, probs).collect()}
    cuts = []
    for c in columns:
        q = np.unique(np.array(found[c] or [], float))
        cuts.append(q[:-1])
    return cuts


def binned(values: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bin numbers of a matrix; NaN falls behind the last threshold."""
    out = np.empty(values.shape, np.uint16)
    for j, cut in enumerate(cuts):
        out[:, j] = np.searchsorted(cut, values[:, j], "left")
    return out


def matrix(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    """Number columns of a batch as a matrix; null becomes NaN."""
    return np.stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns], axis=1)


def blocks(df: DataFrame, kind: str, pack: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """One row for each Arrow batch: the values that ``pack`` makes of it (arrays become bytes)."""
    names = [part.split()[0] for part in kind.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = pack(batch)
                row = {c: v.tobytes() if isinstance(v := made[c], np.ndarray) else v for c in names}
                yield pa.RecordBatch.from_pylist([row])

    return df.mapInArrow(run, kind)


def summed(
    state: DataFrame, tasks: int, add: Callable[[dict, dict[tuple, np.ndarray]], None], shape: Sequence[int], keys: int
) -> dict[tuple, np.ndarray]:
    """Sums by key (a pair of numbers) of what ``add`` puts together from every block.

    ``add(row, totals)`` adds a block's share to the arrays in ``totals``. ``tasks``, ``keys``
    and ``shape`` tell how much all tasks give at most.
    """
    kind = "part int, i int, j int, data binary"
    schema = pa.schema([("part", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                add(batch.slice(at, 1).to_pylist()[0], totals)
        part = TaskContext.get().partitionId()
        if totals:
            yield pa.RecordBatch.from_pylist([{"part": part, "i": i, "j": j, "data": t.tobytes()} for (i, j), t in totals.items()], schema)

    def merge(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        return pa.Table.from_pylist([{"part": 0, "i": rows[0]["i"], "j": rows[0]["j"], "data": _total(rows).tobytes()}], schema)

    found = state.mapInArrow(run, kind)
    if tasks * keys * 8 * int(np.prod(shape)) > DIRECT_BYTES:
        found = found.groupBy("i", "j").applyInArrow(merge, kind)
    by: dict[tuple, list[dict]] = {}
    for r in found.toArrow().to_pylist():
        by.setdefault((r["i"], r["j"]), []).append(r)
    return {key: _total(rows).reshape(shape) for key, rows in by.items()}


def _total(rows: list[dict]) -> np.ndarray:
    total = np.zeros(len(rows[0]["data"]) // 8)
    for r in sorted(rows, key=lambda r: r["part"]):
        total += np.frombuffer(r["data"])
    return total


def fold_sizes(df: DataFrame, classes: int) -> np.ndarray:
    """Rows by (fold, label)."""
    counts = df.groupBy("fold", F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n")).collect()
    out = np.zeros((max((r["fold"] for r in counts), default=0) + 1, classes))
    for r in counts:
        out[r["fold"], r["label"]] = r["n"]
    return out


def held_out(sizes: np.ndarray, folds: int) -> np.ndarray:
    """Rows by (fit, label). One fit a fold takes all other folds; without folds one takes all."""
    return np.array([sizes.sum(axis=0) - sizes[k] for k in range(folds)]) if folds else sizes.sum(axis=0)[None]
