"""Choosing columns by type or name, and reading them as numbers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Names the canonical data set uses.
CORE_NUMERIC = ["MP_Count_per_L", "Risk_Score", "Microplastic_Size_mm_midpoint", "Density_midpoint"]
CATEGORICAL = [
    "Location", "Shape", "Polymer_Type", "pH", "Salinity", "Industrial_Activity",
    "Population_Density", "Risk_Type", "Risk_Level", "Author", "Source",
]
TARGETS = ["Risk_Type", "Risk_Level"]
IDENTIFIER_MARKS = ["ID", "Sample"]


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns of any number type. Booleans are none, so one-hot flags do not become features."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [name for name, kind in df.dtypes if kind == "string"]


def without_identifiers(names: Iterable[str]) -> list[str]:
    return [n for n in names if not any(mark in n for mark in IDENTIFIER_MARKS)]


def present(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    return [n for n in wanted if n in df.columns]


def core_columns(df: DataFrame) -> list[str]:
    """The core measurements that exist, else the first four numeric columns."""
    numeric = without_identifiers(numeric_columns(df))
    return [n for n in CORE_NUMERIC if n in numeric] or numeric[:4]


def quoted(name: str) -> Column:
    """A column by its exact name, even one holding dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is this data's missing marker; Spark keeps it apart from NULL, so fold it in."""
    fixes = {
        n: F.when(~F.isnan(quoted(n)), quoted(n)) for n, kind in df.dtypes if kind in ("double", "float")
    }
    return df.withColumns(fixes) if fixes else df


def number(df: DataFrame, name: str) -> Column:
    """The column as double: unparseable text and NaN become NULL."""
    kind = dict(df.dtypes)[name]
    source = quoted(name)
    if kind in ("double", "float"):
        value = source.cast("double")
        return F.when(~F.isnan(value), value)
    if kind == "string":
        value = source.try_cast("double")
        return F.when(~F.isnan(value), value)
    return source.cast("double")


def coerce_numeric(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({n: number(df, n) for n in names})


def numbers(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Only ``keep`` plus the named columns read as numbers: prunes the scan."""
    return df.select(*[quoted(k) for k in keep], *[number(df, n).alias(n) for n in names])


def drop_missing(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Keep the rows where every named column is present (neither NULL nor NaN).

    Written as plain tests on source columns, which reach the Parquet scan.
    """
    kinds = dict(df.dtypes)
    for n in names:
        df = df.filter(quoted(n).isNotNull())
        if kinds[n] in ("double", "float"):
            df = df.filter(~F.isnan(quoted(n)))
    return df


def present_numbers(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """As ``numbers``, over the rows where all of them are present."""
    rows = numbers(drop_missing(df, names), names, keep)
    return drop_missing(rows, [n for n in names if n in string_columns(df)])


def with_target(df: DataFrame, target: str) -> DataFrame:
    return df.filter(quoted(target).isNotNull())
