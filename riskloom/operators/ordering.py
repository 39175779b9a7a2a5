"""Running totals and ranks over a whole table without a one-task window."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..session import write_out
from .lookup import attach

WINDOW_ROWS = 1 << 20
TASK_ROWS = 1 << 18  # rows of a task that holds many small slices
FEW_TASKS = 64  # up to this many tasks a slice has one of its own
SPREAD_ROWS = 20_000  # rows of an iterative fit worth a task of their own
SPREAD_FEW = 48  # from this many on, a task takes more rows, since every task costs each pass a fixed share,
SPREAD_LARGE = 10**9 // 4_096  # up to so many; from
SPREAD_TASKS = 4_096  # tasks on, it takes more again,
SPREAD_MOST = 2_000_000  # up to so many


def fit_tasks(rows: int, per_task: int = SPREAD_ROWS) -> int:
    """Tasks for the rows of a fit: as many as the rows ask for, whatever the cluster."""
    large = max(per_task, SPREAD_LARGE)
    return max(1, min(rows // per_task, SPREAD_FEW), min(rows // large, SPREAD_TASKS), rows // SPREAD_MOST)


def spread(df: DataFrame, rows: int, order: Sequence[str], per_task: int = SPREAD_ROWS) -> DataFrame:
    """Deal the rows of an iterative fit to tasks by the hash of ``order``, which tells rows apart.

    The number of tasks follows from the number of rows alone and each part is sorted, so a
    seeded fit sees the same rows in the same order on any cluster.
    """
    return df.repartition(fit_tasks(rows, per_task), *order).sortWithinPartitions(*order)


def running_total(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str,
    rows: int,
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Add ``name``: the sum of ``value`` up to and including each row, by group and order.

    ``by`` plus ``order`` must identify a row. Up to ``window_rows`` rows one window per
    group does it. Above, rows are range-partitioned on (by, order), which splits a hot
    group over many partitions; each slice is summed on its own and the totals of the
    slices before it are added from a table of one row per (group, slice). Beyond ``FEW_TASKS``
    small slices share partitions, since each partition costs the driver a sample and a task.
    """
    if rows <= window_rows:
        span = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.sum(value).over(span))
    slices = math.ceil(rows / window_rows)
    tasks = min(slices, max(FEW_TASKS, math.ceil(rows / TASK_ROWS)))
    ranged = df.repartitionByRange(tasks, *by, *order)
    if tasks == slices:
        placed = ranged.withColumn("_slice", F.spark_partition_id())
    else:
        # The id counts a partition's rows in its lower 33 bits.
        at = ranged.sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id())
        inside = F.floor((F.col("_at") % F.lit(1 << 33)) / window_rows)
        placed = at.withColumn("_slice", F.shiftright("_at", 33) * F.lit(1 << 33) + inside).drop("_at")
    placed = write_out(placed, "sorted")
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*by, "_slice")
        .agg(F.sum(value).alias("_sum"))
        .select(*by, "_slice", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    )
    span = (
        Window.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    within = placed.withColumn("_within", F.sum(value).over(span))
    return (
        attach(within, offsets, [*by, "_slice"])
        .withColumn(name, F.col("_within") + F.col("_offset"))
        .drop("_within", "_offset", "_slice")
    )


def rank_rows(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    name: str,
    rows: int,
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Add a 1-based row number by group and order, on the same terms as ``running_total``."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running_total(one, by, order, "_one", name, rows, window_rows).drop("_one")
