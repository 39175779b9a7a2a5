"""Filling and dropping missing values, and quantile bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import number, numeric_columns, quoted
from .quantiles import quantile_values
from .transform import FittedStep, column_stats

# Fixed value: bins a numeric target is cut into.
TARGET_BINS = 4


def _filled(value: Column, p: dict) -> Column:
    return F.coalesce(value, F.lit(p["fill"]).cast("double"))


def fit_median(df: DataFrame, columns: Sequence[str], **quantile_options) -> FittedStep:
    """Exact medians of the non-null values; an all-null column stays null."""
    if not columns:
        return FittedStep({}, _filled)
    medians = quantile_values(df, columns, [0.5], **quantile_options)
    return FittedStep({c: {"fill": medians[c][0]} for c in columns}, _filled)


def fit_mean(df: DataFrame, columns: Sequence[str]) -> FittedStep:
    return FittedStep(column_stats(df, columns, fill=F.avg), _filled)


def columns_with_nulls(df: DataFrame, columns: Sequence[str]) -> list[str]:
    if not columns:
        return []
    row = df.agg(*[F.count_if(number(df, c).isNull()).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[f"_{i}"]]


def drop_null_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop the columns holding any null: one counting pass decides the schema."""
    names = list(columns) if columns is not None else df.columns
    numeric = set(numeric_columns(df))
    tests = {n: (number(df, n) if n in numeric else quoted(n)).isNull() for n in names}
    if not tests:
        return df
    row = df.agg(*[F.count_if(t).alias(f"_{i}") for i, t in enumerate(tests.values())]).first()
    gone = {n for i, n in enumerate(tests) if row[f"_{i}"]}
    return df.select(*[quoted(n) for n in df.columns if n not in gone])


def bin_edges(df: DataFrame, column: str, bins: int = TARGET_BINS, **quantile_options) -> list[float]:
    """Exact quantile edges, repeated ones merged."""
    at = [i / bins for i in range(bins + 1)]
    edges = quantile_values(df, [column], at, **quantile_options)[column]
    return sorted(set(e for e in edges if e is not None))


def quantile_bin(
    df: DataFrame, column: str, bins: int = TARGET_BINS, name: str = "bin", **quantile_options
) -> DataFrame:
    """Bin 0..k-1 by quantile, right-closed, lowest value included; null stays null."""
    value = number(df, column)
    inner = bin_edges(df, column, bins, **quantile_options)[1:-1]
    index = sum((F.when(value > e, 1).otherwise(0) for e in inner), F.lit(0))
    return df.withColumn(name, F.when(value.isNotNull(), index))
