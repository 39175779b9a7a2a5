"""One-hot and label encoding."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Transformer
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import CATEGORICAL, nan_to_null, present, quoted, string_columns, without_identifiers
from ..session import write_out
from .lookup import attach, pin
from .ordering import WINDOW_ROWS, rank_rows

MAX_CATEGORIES = 5_000  # columns one plan can carry; more raises, nothing is dropped


def one_hot_columns(df: DataFrame) -> list[str]:
    """Every text column but identifiers: the default choice."""
    return without_identifiers(string_columns(df))


def listed_categories(df: DataFrame) -> list[str]:
    """The canonical categorical columns that exist (one of them numeric)."""
    return present(df, CATEGORICAL)


def categories(df: DataFrame, columns: Sequence[str], max_categories: int = MAX_CATEGORIES) -> dict[str, list]:
    """The sorted non-null values of each column, found in one pass over the table.

    The values become column names, so they have to fit the plan: more than
    ``max_categories`` in all is an error.
    """
    if not columns:
        return {}
    clean = nan_to_null(df.select(*[quoted(c) for c in columns]))
    kinds = dict(df.dtypes)
    pairs = clean.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(i).alias("_i"), quoted(c).cast("string").alias("_v")) for i, c in enumerate(columns)]
            )
        )
    )
    found = pairs.filter("_v is not null").distinct().limit(max_categories + 1).collect()
    if len(found) > max_categories:
        raise ValueError(f"{list(columns)} hold more than {max_categories} categories; use label_encode or raise the limit")
    number = {"double": float, "float": float, "bigint": int, "int": int}
    return {
        c: sorted((number.get(kinds[c], str)(r["_v"]) for r in found if r["_i"] == i)) for i, c in enumerate(columns)
    }


def one_hot(df: DataFrame, columns: Sequence[str] | None = None, max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """A 0/1 column ``{column}_{value}`` per value in place of each encoded column.

    Untouched columns come first, no value is dropped, and a null row is all zeros.
    """
    columns = list(columns) if columns is not None else one_hot_columns(df)
    values = categories(df, columns, max_categories)
    flags = [
        F.coalesce((quoted(c) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}") for c in columns for v in values[c]
    ]
    return df.select(*[quoted(c) for c in df.columns if c not in columns], *flags)


def _source(df: DataFrame, column: str, missing: str | None) -> DataFrame:
    clean = nan_to_null(df.select(quoted(column).alias("value")))
    return clean.dropna() if missing is None else clean.fillna(missing)


def label_codes(df: DataFrame, column: str, missing: str | None = None, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """(value, code, n): the distinct values in ascending order numbered from 0.

    ``missing`` names the category nulls of a text column fall into; without it nulls
    have no code.
    """
    counts = _source(df, column, missing).groupBy("value").agg(F.count("*").alias("n"))
    counts = pin(counts) or write_out(counts, "values")  # the table itself is read once
    ranked = rank_rows(counts, [], ["value"], "_rank", counts.count(), window_rows)
    return ranked.select("value", (F.col("_rank") - 1).cast("int").alias("code"), "n")


def label_codes_of(df: DataFrame, columns: Sequence[str], missing: str | None = None) -> dict[str, DataFrame]:
    """``label_codes`` of several text columns from one pass over the table."""
    if not columns:
        return {}
    clean = nan_to_null(df.select(*[quoted(c) for c in columns]))
    fill = (lambda v: v) if missing is None else (lambda v: F.coalesce(v, F.lit(missing)))
    pairs = [F.struct(F.lit(i).alias("_i"), fill(quoted(c)).alias("value")) for i, c in enumerate(columns)]
    counts = clean.select(F.inline(F.array(*pairs))).filter("value is not null").groupBy("_i", "value").agg(F.count("*").alias("n"))
    counts = pin(counts) or write_out(counts, "values")
    ranked = rank_rows(counts, ["_i"], ["value"], "_rank", counts.count())
    return {
        c: ranked.filter(F.col("_i") == i).select("value", (F.col("_rank") - 1).cast("int").alias("code"), "n")
        for i, c in enumerate(columns)
    }


def one_hot_sparse(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The table with ``{column}_at`` in place of each encoded text column, and the layout.

    ``{column}_at`` is the place of the row's one among all new columns, null for a null.
    The layout (column_name, value, at) names them. Any number of values fits.
    """
    columns = list(columns) if columns is not None else one_hot_columns(df)
    start, layouts = 0, []
    for c, codes in label_codes_of(df, columns).items():
        placed = codes.select("value", (F.col("code") + start).alias("code"), "n")
        df = label_encode(df, c, name=f"{c}_at", codes=placed).drop(c)
        layouts.append(placed.select(F.lit(c).alias("column_name"), "value", F.col("code").alias("at")))
        start += codes.count()
    if not layouts:
        return df, df.sparkSession.createDataFrame([], "column_name string, value string, at int")
    return df, reduce(DataFrame.unionByName, layouts)


def sparse_codes(df: DataFrame, layout: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """The table of ``one_hot_sparse`` with ``{column}_code`` in place of each ``{column}_at``,
    counted from 0 within its column (null for a null), and the number of codes a column."""
    found = layout.groupBy("column_name").agg(F.min("at").alias("start"), F.count("*").alias("size")).collect()
    sizes = {r["column_name"]: (r["start"], r["size"]) for r in sorted(found, key=lambda r: r["start"])}
    codes = {f"{c}_code": quoted(f"{c}_at") - F.lit(start) for c, (start, _) in sizes.items()}
    kept = [quoted(c) for c in df.columns if c not in {f"{n}_at" for n in sizes}]
    return df.select(*kept, *[code.alias(name) for name, code in codes.items()]), {f"{c}_code": size for c, (_, size) in sizes.items()}


def sparse_stages(spark: SparkSession, numbers: Sequence[str], sizes: dict[str, int], output: str) -> list[Transformer]:
    """Pipeline stages that make a vector of number columns and of the 0/1 columns that codes
    stand for, held as sparse vectors. A code that is its column's size or above is none."""
    if not sizes:
        return [VectorAssembler(inputCols=list(numbers), outputCol=output)]
    vectors = [f"_{c}_vector" for c in sizes]
    # Fitted to the largest codes alone: what it learns are the sizes.
    largest = spark.createDataFrame([tuple(float(n - 1) for n in sizes.values())], ", ".join(f"`{c}` double" for c in sizes))
    encoder = OneHotEncoder(inputCols=list(sizes), outputCols=vectors, dropLast=True, handleInvalid="keep").fit(largest)
    return [encoder, VectorAssembler(inputCols=[*numbers, *vectors], outputCol=output)]


def one_hot_summary(before: DataFrame, after: DataFrame) -> dict:
    """What an encoding has changed: the encoded columns, the new ones, and the new shape."""
    return {
        "encoded": [c for c in before.columns if c not in after.columns],
        "new": [c for c in after.columns if c not in before.columns],
        "shape": (after.count(), len(after.columns)),
    }


def label_encode(
    df: DataFrame,
    column: str,
    name: str | None = None,
    missing: str | None = None,
    codes: DataFrame | None = None,
    window_rows: int = WINDOW_ROWS,
    pin_rows: int | None = None,
) -> DataFrame:
    """Replace a column by its label code (or add the code as ``name``)."""
    codes = codes if codes is not None else label_codes(df, column, missing, window_rows)
    source = quoted(column)
    keyed = df.withColumn("_value", F.coalesce(source, F.lit(missing)) if missing is not None else source)
    table = codes.select(F.col("value").alias("_value"), F.col("code").alias("_code"), F.col("n").alias("_n"))
    return attach(keyed, table, ["_value"], weight="_n", pin_rows=pin_rows).withColumn(name or column, F.col("_code")).drop(
        "_value", "_code", "_n"
    )
