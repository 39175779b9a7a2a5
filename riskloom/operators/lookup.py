"""Attaching small parameter tables to large ones, with the size checked first."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import write_out

PIN_ROWS = 100_000
PIN_BYTES = 64 << 20
HOT_SHARE = 1_000  # a key above 1/1000 of all rows is joined by broadcast; at most 1000 such keys exist


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType) -> DataFrame:
    """A few Python rows as a local relation: its size is known and reading it takes no job."""
    columns = [list(c) for c in zip(*rows)] if rows else [[] for _ in schema]
    kinds = to_arrow_schema(schema)
    arrays = [pa.array(c, type=kinds.field(i).type) for i, c in enumerate(columns)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=schema.names), schema)


def _varies(kind: T.DataType) -> bool:
    """Whether values of a type have no fixed size."""
    if isinstance(kind, T.StructType):
        return any(_varies(f.dataType) for f in kind)
    return isinstance(kind, (T.StringType, T.BinaryType, T.ArrayType, T.MapType))


def _pinned(table: DataFrame, limit: int | None, max_bytes: int) -> tuple[DataFrame | None, DataFrame]:
    """``table`` as a local relation if it is small, and ``table``, written out if it was measured and isn't."""
    limit = PIN_ROWS if limit is None else limit
    if not _varies(table.schema):
        head = table.limit(limit + 1).toArrow()
        return (None, table) if head.num_rows > limit else (table.sparkSession.createDataFrame(head, table.schema), table)
    # Worked out once: the sum and the rows come from the same blocks, and only what is too large is written.
    held = table.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows, size = held.agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
        if rows > limit or (size or 0) > max_bytes:
            return None, write_out(held, "measured")
        return table.sparkSession.createDataFrame(held.toArrow(), table.schema), table
    finally:
        held.unpersist()


def pin(table: DataFrame, limit: int | None = None, max_bytes: int = PIN_BYTES) -> DataFrame | None:
    """``table`` as a local relation if it has at most ``limit`` rows and ``max_bytes``, else None.

    Where a row's size varies, rows and bytes are added up before anything is collected.
    """
    return _pinned(table, limit, max_bytes)[0]


def same_keys(left: DataFrame, right: DataFrame, on: Sequence[str], suffix: str) -> Column:
    """Null-safe equality on keys; the right side carries them under a suffix."""
    return reduce(
        lambda a, b: a & b, [left[f"`{k}`"].eqNullSafe(right[f"`{k}{suffix}`"]) for k in on], F.lit(True)
    )


def _joined(df: DataFrame, table: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    mark = "__r"
    right = table.withColumnsRenamed({k: k + mark for k in on})
    return df.join(right, same_keys(df, right, on, mark), how).drop(*[k + mark for k in on])


def attach_local(df: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join a table already known to be small."""
    return _joined(df, F.broadcast(table), on, how)


def constant(value, kind: T.DataType) -> Column:
    """A Python value, nested or not, as a literal of the given type."""
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.ArrayType):
        return F.array(*[constant(v, kind.elementType) for v in value]).cast(kind)
    if isinstance(kind, T.StructType):
        return F.struct(*[constant(v, f.dataType).alias(f.name) for v, f in zip(value, kind)])
    return F.lit(value).cast(kind)


def beside(df: DataFrame, table: DataFrame) -> DataFrame:
    """Add the values of a one-row table as constants, so that nothing is joined."""
    values = table.first()
    return df.withColumns({f.name: constant(values[f.name], f.dataType) for f in table.schema})


def attach(
    df: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "left",
    weight: str | None = None,
    pin_rows: int | None = None,
) -> DataFrame:
    """Join ``table`` (one row per key) to ``df``; NULL keys match each other.

    Up to ``pin_rows`` rows (``PIN_ROWS``) and ``PIN_BYTES`` the table is broadcast, so ``df`` is not shuffled and a hot
    key costs nothing. Beyond that the tables are shuffled on the key; ``weight`` names
    the column holding each key's row count, and the keys holding more than 1/1000 of
    all rows are then broadcast instead, so no reducer receives a hot key.
    """
    small, sized = _pinned(table, pin_rows, PIN_BYTES)
    if small is not None:
        return attach_local(df, small, on, how)
    table = write_out(table, "lookup") if sized is table else sized
    if weight is None:
        return _joined(df, table, on, how)
    total = table.agg(F.sum(weight)).first()[0]
    hot = pin(table.filter(F.col(weight) > total / HOT_SHARE), HOT_SHARE)
    if hot is None:
        return _joined(df, table, on, how)
    # Rows of hot keys get their values by broadcast and a random salt that matches nothing,
    # which spreads them over the shuffle. The input stays a single branch of the plan.
    values = [c for c in table.columns if c not in on]
    marked = hot.select(*on, *[F.col(c).alias(f"__hot_{c}") for c in values], F.lit(True).alias("__hot"))
    salt = F.when(F.col("__hot"), 1 + F.floor(F.rand(0) * HOT_SHARE)).otherwise(0).cast("bigint")
    salted = _joined(df, F.broadcast(marked), on, "left").withColumn("__salt", salt)
    cold = table.withColumns({"__salt": F.lit(0).cast("bigint"), "__cold": F.lit(True)})
    both = _joined(salted, cold, [*on, "__salt"], "left")
    if how == "inner":
        both = both.filter(F.col("__hot") | F.col("__cold"))
    picked = [F.when(F.col("__hot"), F.col(f"__hot_{c}")).otherwise(F.col(f"`{c}`")).alias(c) for c in values]
    return both.select(*[f"`{c}`" for c in df.columns], *picked)
