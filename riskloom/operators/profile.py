"""Profiles of a table: nulls, duplicates, descriptive statistics, bands, distinct values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import drop_missing, number, numbers, numeric_columns, quoted, string_columns
from ..functions.scalars import adjusted_skewness
from .lookup import attach
from .quantiles import exact_quantiles

# The score bands and the rule that calls a target categorical.
BAND_EDGES = [25.0, 50.0, 75.0]
BAND_NAMES = ["0-25", "25-50", "50-75", "75-100"]
CATEGORICAL_BELOW = 10
TYPE_NAMES = {
    "bigint": "int64", "int": "int32", "double": "float64", "string": "object", "boolean": "bool",
    "timestamp": "datetime64", "timestamp_ntz": "datetime64",
}


def long_form(wide: DataFrame, columns: Sequence[str], fields, keep: Sequence[str] = ()) -> DataFrame:
    """One row per column from a one-row (per ``keep``) table of per-column aggregates."""
    rows = [F.struct(F.lit(c).alias("column_name"), *fields(i, c)) for i, c in enumerate(columns)]
    return wide.select(*keep, F.inline(F.array(*rows)))


def _missing(df: DataFrame, name: str) -> Column:
    value = quoted(name)
    return value.isNull() | F.isnan(value) if dict(df.dtypes)[name] in ("double", "float") else value.isNull()


def null_profile(df: DataFrame) -> DataFrame:
    """Per column: type, missing cells and their percentage, in one pass."""
    names, kinds = df.columns, dict(df.dtypes)
    wide = df.agg(F.count("*").alias("_rows"), *[F.count_if(_missing(df, n)).alias(f"_m{i}") for i, n in enumerate(names)])
    return long_form(
        wide,
        names,
        lambda i, n: [
            F.lit(i).alias("position"),
            F.lit(TYPE_NAMES.get(kinds[n], kinds[n])).alias("type"),
            F.col(f"_m{i}").alias("missing"),
            F.round(100 * F.try_divide(F.col(f"_m{i}"), F.col("_rows")), 2).alias("missing_pct"),
        ],
    )


def table_quality(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells and percentage, column kinds."""
    empty = sum((F.when(_missing(df, n), 1).otherwise(0) for n in df.columns), F.lit(0))
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(empty), F.lit(0)).alias("missing_cells")).select(
        "rows",
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        "missing_cells",
        (100 * F.try_divide(F.col("missing_cells"), F.col("rows") * len(df.columns))).alias("missing_pct"),
        F.lit(len(numeric_columns(df))).cast("bigint").alias("numeric_columns"),
        F.lit(len(string_columns(df))).cast("bigint").alias("string_columns"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows minus distinct whole rows. Copies fold on the map side, so they do not skew."""
    return (
        df.groupBy(*[quoted(n) for n in df.columns])
        .agg(F.count("*").alias("_copies"))
        .agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates"))
    )


def _moments(df: DataFrame, columns: Sequence[str], skewness: bool) -> DataFrame:
    values = numbers(df, columns)
    aggs: list[Column] = []
    for i, c in enumerate(columns):
        v = quoted(c)
        aggs += [
            F.count(v).alias(f"_n{i}"), F.avg(v).alias(f"_mean{i}"), F.stddev_samp(v).alias(f"_std{i}"),
            F.min(v).alias(f"_min{i}"), F.max(v).alias(f"_max{i}"),
        ]
        if skewness:
            aggs.append(adjusted_skewness(v, F.count(v)).alias(f"_skew{i}"))
    names = {"_n": "count", "_mean": "mean", "_std": "std", "_min": "min", "_max": "max", "_skew": "skewness"}
    kept = list(names)[: 6 if skewness else 5]
    return long_form(values.agg(*aggs), columns, lambda i, c: [F.col(f"{k}{i}").alias(names[k]) for k in kept])


def describe(df: DataFrame, columns: Sequence[str] | None = None, **quantile_options) -> DataFrame:
    """count, mean, std (n-1), min, exact quartiles, max: one row per numeric column."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75], **quantile_options)
    return attach(_moments(df, columns, False), quartiles, ["column_name"]).select(
        "column_name", "count", "mean", "std", "min",
        *[F.col("q")[k].alias(name) for k, name in enumerate(["q1", "median", "q3"])], "max",
    )


def distribution_stats(df: DataFrame, column: str, **quantile_options) -> DataFrame:
    """The nine statistics of one column as (position, statistic, value)."""
    quartiles = exact_quantiles(df, [column], [0.25, 0.5, 0.75], **quantile_options)
    both = attach(_moments(df, [column], True), quartiles, ["column_name"])
    shown = {
        "Count": F.col("count").cast("double"), "Mean": F.col("mean"), "Median": F.col("q")[1], "Std": F.col("std"),
        "Min": F.col("min"), "Q1": F.col("q")[0], "Q3": F.col("q")[2], "Max": F.col("max"), "Skewness": F.col("skewness"),
    }
    rows = [
        F.struct(F.lit(i).alias("position"), F.lit(k).alias("statistic"), v.alias("value"))
        for i, (k, v) in enumerate(shown.items())
    ]
    return both.select(F.inline(F.array(*rows)))


def score_bands(df: DataFrame, column: str) -> DataFrame:
    """Counts and shares of the four score bands; empty bands show 0, outer bands are open."""
    v = quoted(column)
    values = numbers(df, [column])
    a, b, c = BAND_EDGES
    tests = [v < a, (v >= a) & (v < b), (v >= b) & (v < c), v >= c]
    wide = values.agg(F.count(v).alias("_n"), *[F.count_if(t).alias(f"_b{i}") for i, t in enumerate(tests)])
    return long_form(
        wide,
        BAND_NAMES,
        lambda i, n: [
            F.col(f"_b{i}").alias("n"), (100 * F.try_divide(F.col(f"_b{i}"), F.col("_n"))).alias("pct"),
        ],
    ).withColumnRenamed("column_name", "band")


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], **quantile_options) -> DataFrame:
    """Long form: (column_name, p, value)."""
    table = exact_quantiles(df, columns, probs, **quantile_options)
    ps = F.array(*[F.lit(float(p)) for p in probs])
    return table.select(
        "column_name", F.inline(F.arrays_zip(ps.alias("p"), F.coalesce("q", F.array()).alias("value")))
    )


def present_values(df: DataFrame, column: str) -> DataFrame:
    return drop_missing(df.select(quoted(column).alias("value")), ["value"])


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The non-null distinct values; sort them where they are shown."""
    return present_values(df, column).distinct()


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency of every non-null value."""
    return present_values(df, column).groupBy("value").agg(F.count("*").alias("n"))


def smallest_class(df: DataFrame, column: str) -> int:
    return value_counts(df, column).agg(F.min("n")).first()[0] or 0


def value_range(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    values = numbers(df, columns)
    wide = values.agg(
        *[f(quoted(c)).alias(f"_{t}{i}") for i, c in enumerate(columns) for f, t in ((F.min, "lo"), (F.max, "hi"))]
    )
    return long_form(wide, columns, lambda i, c: [F.col(f"_lo{i}").alias("min"), F.col(f"_hi{i}").alias("max")])


def target_profile(df: DataFrame, target: str) -> DataFrame:
    """What kind of target a column is: a row per category, or one row with the range.

    A text target, or one with fewer than ten distinct values, asks for classification.
    """
    text = dict(df.dtypes)[target] == "string"
    counts = present_values(df, target).groupBy(F.col("value").alias("_v")).count()
    few = text or counts.limit(CATEGORICAL_BELOW).count() < CATEGORICAL_BELOW
    if few:
        rows = counts.select(F.col("_v").cast("string").alias("category"), F.lit(counts.count()).alias("n_unique"))
        shown = ("Categorical", "Classification", F.col("category"), F.lit(None), F.lit(None))
    else:
        rows = counts.select(number(counts, "_v").alias("_x")).agg(
            F.count("*").alias("n_unique"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")
        )
        shown = ("Numerical", "Regression", F.lit(None), F.col("_lo"), F.col("_hi"))
    kind, model, category, low, high = shown
    return rows.select(
        F.lit(target).alias("target"), F.lit(kind).alias("kind"), F.lit(model).alias("model_type"), "n_unique",
        category.cast("string").alias("category"), low.cast("double").alias("min"), high.cast("double").alias("max"),
    )


def head(df: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    """The first n rows in a stated order: a top-n per partition, then one merge."""
    return df.orderBy(*order).limit(n)
