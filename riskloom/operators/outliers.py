"""Outliers by interquartile fences: detection, capping and their reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import numbers, numeric_columns, quoted
from ..functions.scalars import clip, fixed
from .profile import long_form
from .quantiles import exact_quantiles
from .relation import FENCE_REACH
from .transform import FittedStep


def fit_fences(df: DataFrame, columns: Sequence[str], **quantile_options) -> FittedStep:
    """Quartiles and fences per column; columns without values, and ones that are missing or
    not numeric, are left out."""
    numeric = set(numeric_columns(df))
    columns = [c for c in columns if c in numeric]
    fences = {}
    for row in exact_quantiles(df, columns, [0.25, 0.5, 0.75], **quantile_options).collect() if columns else []:
        if row["q"] is None:
            continue
        q1, median, q3 = row["q"]
        reach = FENCE_REACH * (q3 - q1)
        fences[row["column_name"]] = {
            "q1": q1, "median": median, "q3": q3, "iqr": q3 - q1, "lower": q1 - reach, "upper": q3 + reach,
        }
    ordered = {c: fences[c] for c in columns if c in fences}
    return FittedStep(ordered, lambda v, p: clip(v, F.lit(p["lower"]), F.lit(p["upper"])))


def detect_outliers(df: DataFrame, columns: Sequence[str], **quantile_options) -> DataFrame:
    """One row per column: quartiles, fences, outliers below and above, moments."""
    fences = fit_fences(df, columns, **quantile_options).params
    names = list(fences)
    if not names:
        return df.sparkSession.createDataFrame([], OUTLIER_SCHEMA)
    aggs = []
    for i, c in enumerate(names):
        v, f = quoted(c), fences[c]
        aggs += [
            F.count(v).alias(f"_n{i}"), F.count_if(v < f["lower"]).alias(f"_b{i}"), F.count_if(v > f["upper"]).alias(f"_a{i}"),
            F.min(v).alias(f"_min{i}"), F.max(v).alias(f"_max{i}"), F.avg(v).alias(f"_mean{i}"),
            F.stddev_samp(v).alias(f"_std{i}"),
        ]
    wide = numbers(df, names).agg(*aggs)

    def fields(i: int, c: str):
        f = fences[c]
        outside = F.col(f"_b{i}") + F.col(f"_a{i}")
        return [
            *[F.lit(f[k]).alias(name) for k, name in (("q1", "q1"), ("q3", "q3"), ("iqr", "iqr"))],
            F.lit(f["lower"]).alias("lower_bound"), F.lit(f["upper"]).alias("upper_bound"),
            outside.alias("outlier_count"), (100 * outside / F.col(f"_n{i}")).alias("outlier_percentage"),
            F.col(f"_min{i}").alias("min_value"), F.col(f"_max{i}").alias("max_value"),
            F.col(f"_mean{i}").alias("mean"), F.col(f"_std{i}").alias("std"),
            F.col(f"_b{i}").alias("outliers_below"), F.col(f"_a{i}").alias("outliers_above"),
        ]

    return long_form(wide, names, fields)


OUTLIER_SCHEMA = (
    "column_name string, q1 double, q3 double, iqr double, lower_bound double, upper_bound double, "
    "outlier_count bigint, outlier_percentage double, min_value double, max_value double, mean double, "
    "std double, outliers_below bigint, outliers_above bigint"
)


def outlier_table(detected: DataFrame) -> DataFrame:
    """The detection result as text for display."""
    return detected.select(
        "column_name",
        F.col("outlier_count").alias("outliers"),
        F.concat(fixed(F.col("outlier_percentage"), 1), F.lit("%")).alias("pct"),
        fixed(F.col("lower_bound")).alias("lower_bound"),
        fixed(F.col("upper_bound")).alias("upper_bound"),
    )


def cap_outliers(df: DataFrame, columns: Sequence[str], **quantile_options) -> DataFrame:
    """Clip each numeric column to its fences; NULL stays NULL."""
    return fit_fences(df, columns, **quantile_options).apply(df)


def cap_stats(df: DataFrame, columns: Sequence[str], **quantile_options) -> DataFrame:
    """describe() before and after capping with the number of values that were outside.

    One aggregate serves both sides. The quartiles are those of the fences: they lie
    within the fences, so capping does not move them.
    """
    fences = fit_fences(df, columns, **quantile_options)
    names = list(fences.params)
    measures = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    aggs, rows = [], []
    for i, c in enumerate(names):
        v, p = quoted(c), fences.params[c]
        sides = {"before": v, "after": fences.rewrite(v, p)}
        aggs += [f(side).alias(f"_{s}_{m}{i}") for s, side in sides.items() for m, f in measures.items()]
        aggs.append(F.count_if((v < p["lower"]) | (v > p["upper"])).alias(f"_out{i}"))
        rows += [
            F.struct(
                F.lit(c).alias("column_name"), F.lit(s).alias("stage"),
                *[F.col(f"_{s}_{m}{i}").alias(m) for m in ("count", "mean", "std", "min")],
                *[F.lit(p[q]).alias(q) for q in ("q1", "median", "q3")],
                F.col(f"_{s}_max{i}").alias("max"), F.col(f"_out{i}").alias("outlier_count"),
            )
            for s in sides
        ]
    return numbers(df, names).agg(*aggs).select(F.inline(F.array(*rows)))


def outlier_summary(df: DataFrame, columns: Sequence[str], **quantile_options) -> DataFrame:
    """Mean, std, min and max before and after capping, as four-decimal text."""
    fences = fit_fences(df, columns, **quantile_options)
    names = list(fences.params)
    values = numbers(df, names)
    measures = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    sides = {"before": lambda c: quoted(c), "after": lambda c: fences.rewrite(quoted(c), fences.params[c])}
    wide = values.agg(
        *[
            f(side(c)).alias(f"_{s}_{m}{i}")
            for i, c in enumerate(names) for s, side in sides.items() for m, f in measures.items()
        ]
    )
    return long_form(
        wide, names, lambda i, c: [fixed(F.col(f"_{s}_{m}{i}")).alias(f"{s}_{m}") for m in measures for s in sides]
    )
