"""All statistics of a wide table in two readings.

The first reading takes counts, moments, range and a mergeable quantile sketch of every
column at once. The sketch brackets the quartiles, and with them the outlier fences. The
second deals every value to the segments that the brackets' edges cut a column into: values
inside a bracket are counted one by one, all others a segment at a time. From that small
table come exact quartiles and exact numbers of outliers. Counts prove each bracket; one
that a quartile is not in (the sketch errs with a small probability) is widened and the
second reading repeated, so that the sketch's size changes the cost and never the result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import numbers, numeric_columns, quoted
from ..functions.scalars import adjusted_skewness
from ..session import write_out
from .lookup import local_table
from .ordering import WINDOW_ROWS, running_total
from .profile import TYPE_NAMES
from .relation import FENCE_REACH

SKETCH_K = 1024
QUARTILES = (0.25, 0.5, 0.75)
SUMMARY = (
    "column_name string, type string, rows bigint, missing bigint, missing_pct double, mean double, std double, min double, q1 double, "
    "median double, q3 double, max double, skewness double, lower_bound double, upper_bound double, outliers_below bigint, outliers_above bigint, "
    "outlier_percentage double"
)


def rank_error(k: int) -> float:
    """The sketch's stated bound, with 99 % confidence, on how far a rank is off, as a share of all."""
    return 2.296 / k**0.9021


def _first_reading(values: DataFrame, columns: Sequence[str], k: int) -> dict:
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        v = quoted(c)
        aggs += [
            F.count(v).alias(f"n{i}"), F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}"), F.avg(v).alias(f"mean{i}"),
            F.stddev_samp(v).alias(f"std{i}"), adjusted_skewness(v, F.count(v)).alias(f"skew{i}"), F.kll_sketch_agg_double(v, F.lit(k)).alias(f"s{i}"),
        ]
    return values.agg(*aggs)


def _brackets(row: dict, i: int, error: float, quantile: dict) -> list[tuple[float, float]]:
    """Of the three quartiles and both fences: where they lie if no rank is off by more than ``error``."""
    least, most = row[f"min{i}"], row[f"max{i}"]
    spans = []
    for p in QUARTILES:
        a, b = p - error, p + error
        spans.append((quantile[i, a] if a > 0 else least, quantile[i, b] if b < 1 else most))
    (q1a, q1b), _, (q3a, q3b) = spans
    reach = FENCE_REACH
    lower = ((1 + reach) * q1a - reach * q3b, (1 + reach) * q1b - reach * q3a)
    upper = ((1 + reach) * q3a - reach * q1b, (1 + reach) * q3b - reach * q1a)
    # Rounding of a fence must not leave its bracket.
    wide = [(a - 1e-9 * (abs(a) + abs(b)), b + 1e-9 * (abs(a) + abs(b))) for a, b in (lower, upper)]
    return spans + wide


def _segment(x: Column, edges: Sequence[float]) -> Column:
    """2k + 1 for the k-th edge itself, and even numbers between the edges."""
    place = F.lit(0)
    for e in edges:
        place = place + (x >= F.lit(e)).cast("int") + (x > F.lit(e)).cast("int")
    return place


def _second_reading(values: DataFrame, columns: Sequence[str], spans: dict) -> DataFrame:
    """(i, segment, value, n): value is null outside all brackets."""
    # Segments are columns of a step of their own, so that each is worked out once.
    placed = values.select(*[quoted(columns[i]).alias(f"x{i}") for i in spans], *[_segment(quoted(columns[i]), edges).alias(f"s{i}") for i, (edges, _) in spans.items()])
    parts = []
    for i, (edges, inside) in spans.items():
        kept = F.array(*[F.lit(any(a <= s <= b for a, b in inside)) for s in range(2 * len(edges) + 1)])
        parts.append(F.struct(F.lit(i).alias("i"), F.col(f"s{i}").alias("segment"), F.when(F.get(kept, F.col(f"s{i}")), F.col(f"x{i}")).alias("value")))
    pairs = placed.select(F.inline(F.array(*parts))).where("segment is not null")
    return write_out(pairs.groupBy("i", "segment", "value").agg(F.count("*").alias("n")), "segments")


def whole_profile(df: DataFrame, columns: Sequence[str] | None = None, k: int = SKETCH_K, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """One row per numeric column: missing cells, moments, range, exact quartiles, skewness,
    fences and the numbers of outliers. NaN counts as missing; a column without values has
    counts only."""
    columns = numeric_columns(df) if columns is None else [c for c in columns if c in set(numeric_columns(df))]
    spark, kinds = df.sparkSession, dict(df.dtypes)
    if not columns:
        return spark.createDataFrame([], SUMMARY)
    values = numbers(df, columns).select(*[quoted(c).cast("double").alias(c) for c in columns])
    found = write_out(_first_reading(values, columns, k), "sketches")
    row = found.drop(*[f"s{i}" for i in range(len(columns))]).first().asDict()
    filled = [i for i in range(len(columns)) if row[f"n{i}"]]
    quartiles: dict[int, list[float]] = {}
    tables: dict[int, tuple] = {}
    error, open_ = 2 * rank_error(k), list(filled)
    while open_:
        spans = _spans(found, row, open_, error)
        table = _second_reading(values, columns, {i: s[:2] for i, s in spans.items()})
        exact = _order_statistics(table, row, spans, window_rows)
        for i in open_:
            if exact.get(i) is not None:
                quartiles[i], tables[i] = exact[i], (table, spans[i])
        open_ = [i for i in open_ if i not in quartiles]
        error *= 4
    outside = _outliers(spark, row, quartiles, tables)
    out = []
    for i, c in enumerate(columns):
        n, rows = row[f"n{i}"], row["rows"]
        head = (c, TYPE_NAMES.get(kinds[c], kinds[c]), rows, rows - n, round(100 * (rows - n) / rows, 2) if rows else None)
        if i not in quartiles:
            out.append((*head, *[None] * 13))
            continue
        q1, median, q3 = quartiles[i]
        reach = FENCE_REACH * (q3 - q1)
        below, above = outside[i]
        out.append(
            (*head, row[f"mean{i}"], row[f"std{i}"], row[f"min{i}"], q1, median, q3, row[f"max{i}"], row[f"skew{i}"], q1 - reach, q3 + reach, below, above, 100 * (below + above) / n)
        )
    return spark.createDataFrame(out, SUMMARY)


def _spans(found: DataFrame, row: dict, wanted: Sequence[int], error: float) -> dict[int, tuple]:
    """Per column: sorted edges, brackets as segment numbers, and brackets as values."""
    at = [p + side * error for p in QUARTILES for side in (-1, 1)]
    ask = {i: [min(max(a, 0.0), 1.0) for a in at] for i in wanted}
    got = found.select(*[F.kll_sketch_get_quantile_double(f"s{i}", F.array(*map(F.lit, ask[i]))).alias(f"q{i}") for i in wanted]).first()
    quantile = {(i, a): q for i in wanted for a, q in zip(at, got[f"q{i}"])}
    out = {}
    for i in wanted:
        spans = _brackets(row, i, error, quantile)
        edges = sorted({e for span in spans for e in span})
        place = {e: 2 * k + 1 for k, e in enumerate(edges)}
        out[i] = edges, [(place[a], place[b]) for a, b in spans], spans
    return out


def _order_statistics(table: DataFrame, row: dict, spans: dict, window_rows: int) -> dict[int, list[float] | None]:
    """The exact quartiles of each column, or None where a bracket doesn't hold one."""
    counts = {(r["i"], r["segment"], r["known"]): r["n"] for r in table.groupBy("i", "segment", F.col("value").isNotNull().alias("known")).agg(F.sum("n").alias("n")).collect()}
    gaps, targets = [], []
    for i, (edges, inside, _) in spans.items():
        before = 0
        for s in range(2 * len(edges) + 1):
            gaps.append((i, s, before))  # values told only by segment, below this one
            before += counts.get((i, s, False), 0)
        n = row[f"n{i}"]
        for k, p in enumerate(QUARTILES):
            position = (n - 1) * p
            targets += [(i, k, int(np.floor(position))), (i, k, int(np.ceil(position)))]
    spark = table.sparkSession
    known = table.where("value is not null")
    total = running_total(known, ["i"], ["value"], "n", "upto", sum(1 for _ in spans) and known.count(), window_rows)
    offsets = spark.createDataFrame(gaps, "i int, segment int, gap bigint")
    placed = total.join(F.broadcast(offsets), ["i", "segment"]).select("i", "value", (F.col("upto") + F.col("gap")).alias("upto"), "n")
    wanted = spark.createDataFrame(sorted(set(targets)), "j int, k int, rank bigint")
    hits = placed.join(F.broadcast(wanted), (F.col("i") == F.col("j")) & (F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
    value = {(r["i"], r["k"], r["rank"]): r["value"] for r in hits.select("i", "k", "rank", "value").collect()}
    out: dict[int, list[float] | None] = {}
    for i, (_, _, brackets) in spans.items():
        found = []
        for k, p in enumerate(QUARTILES):
            position = (row[f"n{i}"] - 1) * p
            low, high = int(np.floor(position)), int(np.ceil(position))
            a, b = value.get((i, k, low)), value.get((i, k, high))
            # A rank that lies in a segment without values is in no bracket, or in another's.
            if a is None or b is None or not brackets[k][0] <= a <= b <= brackets[k][1]:
                break
            found.append(a if low == high else (high - position) * a + (position - low) * b)
        out[i] = found if len(found) == len(QUARTILES) else None
    return out


def _outliers(spark, row: dict, quartiles: dict, tables: dict) -> dict[int, tuple[int, int]]:
    """Values below the lower and above the upper fence."""
    fences = {}
    for i, (q1, _, q3) in quartiles.items():
        reach = FENCE_REACH * (q3 - q1)
        fences[i] = (q1 - reach, q3 + reach)
    out = {}
    for table in {id(t): t for t, _ in tables.values()}.values():
        mine = {i: spans for i, (t, spans) in tables.items() if t is table}
        limits = [(i, *fences[i], spans[1][3][0], spans[1][4][0]) for i, spans in mine.items()]
        told = table.join(F.broadcast(spark.createDataFrame(limits, "i int, lower double, upper double, first_low int, first_high int")), "i")
        below = F.when(F.coalesce(F.col("value") < F.col("lower"), F.col("segment") < F.col("first_low")), F.col("n"))
        upto = F.when(F.coalesce(F.col("value") <= F.col("upper"), F.col("segment") < F.col("first_high")), F.col("n"))
        for r in told.groupBy("i").agg(F.sum(below).alias("b"), F.sum(upto).alias("u")).collect():
            out[r["i"]] = (r["b"] or 0, row[f"n{r['i']}"] - (r["u"] or 0))
    return out
