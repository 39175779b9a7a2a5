"""Splits and folds by the rank of a hashed row id, and balanced class weights.

Shuffling rows to deal them out is not needed: a split is "the rows whose hash ranks
below a cut", so only the cut has to be found (``rank_cuts``), and assigning rows is a
comparison. Sizes are exact, whatever share of the rows one class holds.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.columns import quoted
from ..functions.scalars import hash_key
from ..session import write_out
from .lookup import attach, attach_local, beside, local_table, pin
from .quantiles import rank_cuts

# Seed, share of the test set, folds.
SEED = 42
TEST_SHARE = 0.2
FOLDS = 5


def class_sizes(df: DataFrame, target: str) -> dict:
    """Rows per class, for a target with a bounded number of classes."""
    table = pin(df.groupBy(quoted(target).alias("_c")).agg(F.count("*").alias("_n")))
    if table is None:
        raise ValueError(f"{target} has too many classes to stratify by")
    return {r["_c"]: r["_n"] for r in sorted(table.collect(), key=lambda r: (r["_c"] is None, r["_c"]))}


def _deal(
    df: DataFrame, id_col: str, by: str | None, ranks: dict, sizes: dict, seed: int, name: str, window_rows: int | None = None
) -> DataFrame:
    """Number each row by how many of its group's cuts it lies beyond.

    ``ranks[group]`` lists the last rank of every part but the final one.
    """
    keyed = df.withColumn("_key", hash_key(quoted(id_col), seed)).withColumn("_tie", quoted(id_col))
    real = {g: [r for r in rs if r > 0] for g, rs in ranks.items()}
    edges = rank_cuts(keyed, by, "_key", "_tie", real, sizes, window_rows)
    pair = T.StructType([T.StructField("_key", T.LongType()), T.StructField("_tie", df.schema[id_col].dataType)])
    # A cut at rank 0 has no row: every row lies beyond it.
    rows = [(g, edges[g], len(rs) - len(real[g])) for g, rs in ranks.items()]
    columns = [T.StructField("_edges", T.ArrayType(pair)), T.StructField("_skipped", T.IntegerType())]
    if by is None:
        table = local_table(df.sparkSession, [r[1:] for r in rows], T.StructType(columns))
        dealt = beside(keyed, table)
    else:
        table = local_table(df.sparkSession, rows, T.StructType([df.schema[by], *columns]))
        dealt = attach_local(keyed, table, [by])
    me = F.struct("_key", "_tie")
    part = F.size(F.filter("_edges", lambda e: me > e)) + F.col("_skipped")
    return dealt.withColumn(name, part.cast("int")).drop("_key", "_tie", "_edges", "_skipped")


def random_split(
    df: DataFrame,
    id_col: str,
    share: float = TEST_SHARE,
    seed: int = SEED,
    name: str = "is_test",
    window_rows: int | None = None,
) -> DataFrame:
    """Add 0/1 ``is_test``: exactly ceil(n x share) rows, those of the lowest hash."""
    n = df.count()
    test = math.ceil(n * share - 1e-9)
    return _as_flag(_deal(df, id_col, None, {None: [test]}, {None: n}, seed, name, window_rows), name)


def mark_lowest(
    df: DataFrame, id_col: str, by: str, counts: dict, sizes: dict, seed: int, name: str
) -> DataFrame:
    """Add a 0/1 flag on exactly ``counts[group]`` rows of each group, those of the lowest hash."""
    return _as_flag(_deal(df, id_col, by, {g: [c] for g, c in counts.items()}, sizes, seed, name), name)


def stratified_counts(sizes: dict, share: float) -> dict:
    """Test rows per class: train shares by largest remainder, the rest is test."""
    n = sum(sizes.values())
    test = math.ceil(n * share - 1e-9)
    train = n - test
    if min(train, test) < len(sizes):
        raise ValueError("both parts of a stratified split need a row per class")
    whole = {g: train * c // n for g, c in sizes.items()}
    rest = sorted(sizes, key=lambda g: -(train * sizes[g] % n))
    for g in rest[: train - sum(whole.values())]:
        whole[g] += 1
    return {g: sizes[g] - whole[g] for g in sizes}


def stratified_split(
    df: DataFrame, id_col: str, target: str, share: float = TEST_SHARE, seed: int = SEED, name: str = "is_test"
) -> DataFrame:
    """As ``random_split`` within each class; plain if some class has a single row."""
    sizes = class_sizes(df, target)
    if not sizes or min(sizes.values()) < 2:
        return random_split(df, id_col, share, seed, name)
    tests = {g: [t] for g, t in stratified_counts(sizes, share).items()}
    return _as_flag(_deal(df, id_col, target, tests, sizes, seed, name), name)


def _as_flag(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, (F.col(name) == 0).cast("int"))


def fold_ends(sizes: dict, folds: int) -> dict:
    """Last rank of each fold but the final one, per class.

    Lay the classes end to end and deal positions out in turn: fold i of a class gets as
    many rows as it has positions p with p mod folds = i. Fold and class sizes then both
    differ by at most one.
    """
    ends, start = {}, 0
    for g, c in sizes.items():
        stop, total, list_ = start + c, 0, []
        for i in range(folds - 1):
            total += (stop - 1 - i) // folds - (start - 1 - i) // folds
            list_.append(total)
        ends[g], start = list_, stop
    return ends


def assign_folds(
    df: DataFrame,
    id_col: str,
    target: str,
    folds: int = FOLDS,
    seed: int = SEED,
    name: str = "fold",
    window_rows: int | None = None,
) -> DataFrame:
    """Add a stratified fold number 0..folds-1."""
    sizes = class_sizes(df, target)
    if folds < 2 or folds > max(sizes.values(), default=0):
        raise ValueError("folds must be between 2 and the size of the largest class")
    return _deal(df, id_col, target, fold_ends(sizes, folds), sizes, seed, name, window_rows)


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """(class, n, weight) with weight = rows / (classes x rows of the class), for any number of classes."""
    counts = df.groupBy(quoted(target)).agg(F.count("*").alias("n"))
    counts = pin(counts) or write_out(counts, "classes")
    rows, classes = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    return counts.select(quoted(target), "n", (F.lit(float(rows)) / (F.lit(classes) * F.col("n"))).alias("weight"))


def with_class_weight(df: DataFrame, target: str, name: str = "weight") -> DataFrame:
    weights = class_weights(df, target).select(quoted(target), F.col("weight").alias(name), F.col("n").alias("_n"))
    return attach(df, weights, [target], weight="_n").drop("_n")


def parts(df: DataFrame, name: str = "is_test") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(name) == 0).drop(name), df.filter(F.col(name) == 1).drop(name)
