"""Fitted column steps: standard scaling and log transform, with fit and apply apart.

Fitting costs one small aggregate whose result is a handful of numbers per column;
applying is a projection of literals, so it needs no shuffle, reads each row once and
works on a streaming table too.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import number, numbers, quoted
from ..functions.scalars import adjusted_skewness, log_shift
from .relation import skewness

# Fixed value: a column is skewed beyond this.
SKEWED_BEYOND = 0.5


@dataclass(frozen=True)
class FittedStep:
    """Numbers per column and the expression that uses them."""

    params: dict[str, dict[str, float | None]]
    rewrite: Callable[[Column, dict], Column]

    def apply(self, df: DataFrame) -> DataFrame:
        changes = {c: self.rewrite(number(df, c), p) for c, p in self.params.items() if c in df.columns}
        return df.withColumns(changes) if changes else df

    def table(self, df: DataFrame) -> DataFrame:
        """The parameters as (column_name, parameter, value)."""
        rows = [(c, k, v) for c, p in self.params.items() for k, v in p.items()]
        return df.sparkSession.createDataFrame(rows, "column_name string, parameter string, value double")


def column_stats(df: DataFrame, columns: Sequence[str], **aggregates) -> dict[str, dict]:
    """Several aggregates of several columns as Python numbers, in one pass."""
    if not columns:
        return {}
    values = numbers(df, columns)
    row = values.agg(
        *[f(quoted(c)).alias(f"{k}_{i}") for i, c in enumerate(columns) for k, f in aggregates.items()]
    ).first()
    return {c: {k: row[f"{k}_{i}"] for k in aggregates} for i, c in enumerate(columns)}


def fit_standard_scale(df: DataFrame, columns: Sequence[str]) -> FittedStep:
    """Mean and population standard deviation over the non-null values."""
    stats = column_stats(df, columns, mean=F.avg, std=F.stddev_pop)

    def rewrite(value: Column, p: dict) -> Column:
        return (value - F.lit(p["mean"]).cast("double")) / F.lit(p["std"] or 1.0)

    return FittedStep(stats, rewrite)


def fit_log_transform(df: DataFrame, columns: Sequence[str], only_skewed: bool = False) -> FittedStep:
    """log1p after a shift that makes the smallest value positive.

    ``only_skewed`` leaves columns with |skewness| of at most 0.5 as they are.
    """
    stats = column_stats(df, columns, low=F.min, skew=lambda v: adjusted_skewness(v, F.count(v)))
    chosen = {
        c: {"shift": log_shift(s["low"])}
        for c, s in stats.items()
        if not only_skewed or (s["skew"] is not None and abs(s["skew"]) > SKEWED_BEYOND)
    }
    return FittedStep(chosen, lambda value, p: F.log1p(value + F.lit(p["shift"])))


def skew_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Skewness to four places and whether the unrounded value is beyond 0.5."""
    return skewness(df, columns).select(
        "column_name",
        F.round("skewness", 4).alias("skewness"),
        F.when(F.abs("skewness") > SKEWED_BEYOND, "Yes").otherwise("No").alias("skewed"),
    )


def skew_before_after(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Skewness of each column before and after its log transform, in two passes."""
    step = fit_log_transform(df, columns)
    after = {c: f"{c}__after" for c in columns}
    both = numbers(df, columns).withColumns({after[c]: step.rewrite(quoted(c), step.params[c]) for c in columns})
    table = skewness(both, [*columns, *after.values()])
    name = F.regexp_replace("column_name", "__after$", "")
    is_after = F.col("column_name").endswith("__after")
    return table.groupBy(name.alias("column_name")).agg(
        F.max(F.when(~is_after, F.col("skewness"))).alias("before"),
        F.max(F.when(is_after, F.col("skewness"))).alias("after"),
    )
