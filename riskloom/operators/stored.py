"""Statistics of a growing table, kept a part at a time.

A part (a day, a file, a load) is read once and leaves a row for each column in a Parquet
store: counts, range, moments, a quantile sketch (KLL) and a distinct-count sketch (HLL). All
of them merge, so statistics over any choice of parts are read from the store alone: an
appended part costs only itself, and one that is loaded again replaces its rows.

Counts, range, mean and deviation are exact. A quantile's rank is off by at most
``rank_error`` of all values, a number of distinct values by ``distinct_error`` of itself,
each with some 99 % confidence.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import nan_to_null, numeric_columns, quoted, string_columns
from .summary import rank_error

QUANTILE_K = 1024
DISTINCT_LG_K = 13
STORE = (
    "column_name string, rows bigint, n bigint, min double, max double, mean double, squares double, quantiles binary, distinct binary, part string"
)


def distinct_error(lg_k: int = DISTINCT_LG_K) -> float:
    """Three standard errors of a merged distinct-count sketch, as a share of the count."""
    return 3 * 1.04 / math.sqrt(2**lg_k)


def _names(df: DataFrame, columns: Sequence[str] | None, but: Sequence[str]) -> list[str]:
    known = set(numeric_columns(df)) | set(string_columns(df))
    return [c for c in (df.columns if columns is None else columns) if c in known and c not in but]


def _sketched(df: DataFrame, columns: Sequence[str], by: Sequence[str], k: int, lg_k: int) -> DataFrame:
    """The store's rows, by part: one pass over the table for all columns."""
    numeric, kinds, aggs = set(numeric_columns(df)), dict(df.dtypes), [F.count("*").alias("_rows")]
    clean = nan_to_null(df.select(*by, *[quoted(c) for c in columns]))
    for i, c in enumerate(columns):
        v = quoted(c)
        aggs.append(F.count(v).alias(f"n{i}"))
        if c in numeric:
            x = v.cast("double") + F.lit(0.0)  # -0.0 and 0.0 are one value
            aggs += [
                F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"), F.avg(x).alias(f"mean{i}"),
                (F.var_pop(x) * F.count(v)).alias(f"squares{i}"), F.kll_sketch_agg_double(x, F.lit(k)).alias(f"q{i}"),
            ]
        key = v.cast("bigint") if kinds[c] in ("tinyint", "smallint", "int", "bigint") else (v.cast("double") + F.lit(0.0)).cast("string") if c in numeric else v
        aggs.append(F.hll_sketch_agg(key, F.lit(lg_k)).alias(f"d{i}"))

    def fields(i: int, c: str) -> list[Column]:
        def value(name: str, kind: str) -> Column:
            return F.col(f"{name}{i}") if c in numeric else F.lit(None).cast(kind)

        return [
            F.lit(c).alias("column_name"), F.col("_rows").alias("rows"), F.col(f"n{i}").alias("n"),
            *[value(name, "double").alias(name) for name in ("min", "max", "mean", "squares")],
            value("q", "binary").alias("quantiles"), F.col(f"d{i}").alias("distinct"),
        ]

    wide = clean.groupBy(*by).agg(*aggs)
    return wide.select(*by, F.inline(F.array(*[F.struct(*fields(i, c)) for i, c in enumerate(columns)])))


def store_part(df: DataFrame, path: str, part: str, columns: Sequence[str] | None = None, k: int = QUANTILE_K, lg_k: int = DISTINCT_LG_K) -> None:
    """Add the rows of ``df`` as one part, or replace the part of that name."""
    names = _names(df, columns, ())
    if not names:
        raise ValueError("no numeric or text column to keep statistics of")
    rows = _sketched(df, names, (), k, lg_k).withColumn("part", F.lit(part))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def store_parts(df: DataFrame, path: str, part_col: str, columns: Sequence[str] | None = None, k: int = QUANTILE_K, lg_k: int = DISTINCT_LG_K) -> None:
    """Add many parts at once, named by a column; rows without a name are the part of nulls."""
    names = _names(df, columns, (part_col,))
    if not names:
        raise ValueError("no numeric or text column to keep statistics of")
    rows = _sketched(df.withColumn("_part", quoted(part_col).cast("string")), names, ("_part",), k, lg_k)
    rows.withColumnRenamed("_part", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def stored(spark: SparkSession, path: str, parts: Sequence[str] | None = None) -> DataFrame:
    """The store's rows, of all parts or of some: only their files are read."""
    rows = spark.read.schema(STORE).parquet(path)
    return rows if parts is None else rows.where(F.col("part").isin(list(parts)))


def merged(rows: DataFrame) -> DataFrame:
    """(column_name, rows, n, min, max, mean, std, quantiles, distinct) over all parts given."""
    whole = rows.groupBy("column_name").agg((F.sum(F.col("n") * F.col("mean")) / F.nullif(F.sum(F.when(F.col("mean").isNotNull(), F.col("n"))), F.lit(0))).alias("m"))
    # Squares around a part's own mean become squares around the mean of all.
    moved = rows.join(F.broadcast(whole), "column_name").withColumn("squares", F.col("squares") + F.col("n") * (F.col("mean") - F.col("m")) ** 2)
    return moved.groupBy("column_name").agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.min("min").alias("min"), F.max("max").alias("max"), F.max("m").alias("mean"),
        F.sqrt(F.sum("squares") / F.nullif(F.sum("n") - 1, F.lit(0))).alias("std"), F.kll_merge_agg_double("quantiles").alias("quantiles"),
        F.hll_union_agg("distinct").alias("distinct"),
    )


def approximate_quantiles(rows: DataFrame, probs: Sequence[float], k: int = QUANTILE_K) -> DataFrame:
    """(column_name, p, n, value, low, high): each quantile, and values that bracket the true one."""
    error, all_ = rank_error(k), merged(rows).where("mean is not null")  # numeric, with values

    def at(moved: float) -> Column:  # the ranks must be literals
        ranks = [F.lit(min(max(float(p) + moved, 0.0), 1.0)) for p in probs]
        return F.kll_sketch_get_quantile_double("quantiles", F.array(*ranks))

    ranks = F.array(*[F.lit(float(p)) for p in probs])
    found = F.arrays_zip(ranks.alias("p"), at(0.0).alias("value"), at(-error).alias("low"), at(error).alias("high"))
    return all_.select("column_name", "n", F.inline(found)).select("column_name", "p", "n", "value", "low", "high")


def approximate_distinct(rows: DataFrame, lg_k: int = DISTINCT_LG_K) -> DataFrame:
    """(column_name, n, n_distinct, low, high): the number of distinct values, and its bounds."""
    found, error = F.hll_sketch_estimate("distinct"), distinct_error(lg_k)
    return merged(rows).select(
        "column_name", "n", found.alias("n_distinct"), F.floor(found / (1 + error)).cast("bigint").alias("low"), F.ceil(found / (1 - error)).cast("bigint").alias("high")
    )
