"""Shape and relation statistics: skewness, correlation, trend lines, boxes, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import numbers, present_numbers, quoted
from ..functions.scalars import adjusted_skewness
from .lookup import attach, beside
from .profile import long_form
from .quantiles import exact_quantiles

# Bins of the histogram and reach of the box whiskers.
HISTOGRAM_BINS = 30
FENCE_REACH = 1.5


def skewness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    values = numbers(df, columns)
    wide = values.agg(
        *[adjusted_skewness(quoted(c), F.count(quoted(c))).alias(f"_s{i}") for i, c in enumerate(columns)]
    )
    return long_form(wide, columns, lambda i, c: [F.col(f"_s{i}").alias("skewness")])


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation over the rows where both are present."""
    return present_numbers(df, [x, y]).agg(F.corr(quoted(x), quoted(y)).alias("correlation"))


def trend_line(df: DataFrame, x: str, y: str, by: str | None = None) -> DataFrame:
    """Least-squares line of y on x, per group if the group column exists, else overall."""
    keys = [by] if by is not None and by in df.columns else []
    points = numbers(df, [x, y], keep=keys)
    return points.groupBy(*keys).agg(
        F.regr_count(quoted(y), quoted(x)).alias("n"),
        F.regr_slope(quoted(y), quoted(x)).alias("slope"),
        F.regr_intercept(quoted(y), quoted(x)).alias("intercept"),
        F.regr_r2(quoted(y), quoted(x)).alias("r2"),
    )


def scatter_pairs(df: DataFrame, x: str, y: str, colour: str | None = None) -> DataFrame:
    """(x, y, colour) over the rows with both coordinates."""
    keep = [colour] if colour is not None and colour in df.columns else []
    return present_numbers(df, [x, y], keep=keep)


def _grouped(df: DataFrame, column: str, by: str | None) -> tuple[DataFrame, list[str]]:
    """Value and group as text; a missing group is a category of its own, named nan."""
    keys = [by] if by is not None else []
    rows = present_numbers(df, [column], keep=keys)
    if keys:
        rows = rows.withColumn(by, F.coalesce(quoted(by).cast("string"), F.lit("nan")))
    return rows, keys


def _fenced(df: DataFrame, column: str, by: str | None, options: dict) -> tuple[DataFrame, list[str]]:
    rows, keys = _grouped(df, column, by)
    q = exact_quantiles(rows, [column], [0.25, 0.5, 0.75], by=keys, **options).select(
        *keys, *[F.col("q")[i].alias(f"_q{i + 1}") for i in range(3)]
    )
    fenced = attach(rows, q, keys) if keys else beside(rows, q)
    reach = FENCE_REACH * (F.col("_q3") - F.col("_q1"))
    value = quoted(column)
    return fenced.withColumn("_out", (value < F.col("_q1") - reach) | (value > F.col("_q3") + reach)), keys


def box_stats(df: DataFrame, column: str, by: str | None = None, **quantile_options) -> DataFrame:
    """Quartiles, whiskers (extreme values inside the fences) and outlier count per group."""
    fenced, keys = _fenced(df, column, by, quantile_options)
    inside = F.when(~F.col("_out"), quoted(column))
    return fenced.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[F.max(f"_q{i}").alias(name) for i, name in ((1, "q1"), (2, "median"), (3, "q3"))],
        F.min(inside).alias("whisker_low"),
        F.max(inside).alias("whisker_high"),
        F.count_if(F.col("_out")).alias("outliers"),
    )


def box_outliers(df: DataFrame, column: str, by: str | None = None, **quantile_options) -> DataFrame:
    """The points outside their group's fences."""
    fenced, keys = _fenced(df, column, by, quantile_options)
    return fenced.filter("_out").select(*keys, quoted(column))


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Counts of equal-width bins over the non-null range; the last bin is closed."""
    values = present_numbers(df, [column])
    v = quoted(column)
    low, high = values.agg(F.min(v), F.max(v)).first()
    if low is None:
        return values.sparkSession.createDataFrame([], "bin int, low double, high double, n bigint")
    width = (high - low) / bins or 1.0
    index = F.least(F.floor((v - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = values.groupBy(index.alias("bin")).agg(F.count("*").alias("n"))
    every = values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return attach(every, counts, ["bin"]).select(
        "bin",
        (F.lit(low) + F.col("bin") * F.lit(width)).alias("low"),
        (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )

