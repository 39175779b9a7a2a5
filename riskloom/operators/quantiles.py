"""Exact quantiles and exact rank cuts by bracketing.

Spark's ``percentile`` keeps every distinct value of a group in one reducer. That is
right for groups of a checked size and impossible beyond. Larger groups go the way of
Floyd and Rivest's selection: a sample brackets each wanted order statistic, a counting
pass proves that the bracket holds it, and only the values inside (well under a percent
of the rows) are shuffled and ranked. The sample decides how much is shuffled, never
the result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import numbers
from ..functions.scalars import KEY_BITS
from ..session import write_out
from .lookup import attach, attach_local, beside, local_table, pin
from .ordering import WINDOW_ROWS, rank_rows, running_total

GROUP_CELLS = 1 << 22  # values (rows x columns) of one group that one task may hold
SAMPLE_ROWS = 1 << 16
SAMPLE_SEED = 42


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    group_cells: int = GROUP_CELLS,
    sample_rows: int = SAMPLE_ROWS,
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """One row per (group, column): ``n`` and ``q``, the quantiles at ``probs``.

    Linear interpolation at (n-1)p over the non-null values; ``q`` is NULL when n is 0.
    """
    by, columns, probs = list(by), list(columns), list(probs)
    work = numbers(df, columns, keep=by)
    group_rows = group_cells // max(len(columns), 1)
    sizes = work.groupBy(*by).agg(
        F.count("*").alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(f"_n{i}") for i, c in enumerate(columns)]
    )
    if not by:
        counted = sizes.first()
        if counted["_rows"] <= group_rows:
            return _built_in(work, columns, probs, by)
        return _bracketed(work, columns, probs, by, pin(sizes), sample_rows, window_rows)
    hot = sizes.filter(F.col("_rows") > group_rows)
    small_hot = pin(hot)
    if small_hot is None:
        small_hot = write_out(hot, "hot")
    elif small_hot.isEmpty():
        return _built_in(work, columns, probs, by)
    heavy = attach(work, small_hot.select(*by), by, how="left_semi")
    light = attach(work, small_hot.select(*by), by, how="left_anti")
    return _built_in(light, columns, probs, by).unionByName(
        _bracketed(heavy, columns, probs, by, small_hot, sample_rows, window_rows)
    )


def _per_column(columns: Sequence[str], fields) -> Column:
    """Turn per-column aggregates into one row per column."""
    return F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), *fields(i, c)) for i, c in enumerate(columns)]))


def _built_in(work: DataFrame, columns, probs, by) -> DataFrame:
    values = [F.col(f"`{c}`") for c in columns]
    aggs = [F.count(v).alias(f"_n{i}") for i, v in enumerate(values)]
    aggs += [F.percentile(v, F.array(*[F.lit(float(p)) for p in probs])).alias(f"_q{i}") for i, v in enumerate(values)]
    return work.groupBy(*by).agg(*aggs).select(
        *by, _per_column(columns, lambda i, c: [F.col(f"_n{i}").alias("n"), F.col(f"_q{i}").alias("q")])
    )


def _bracketed(work, columns, probs, by, sizes, sample_rows, window_rows) -> DataFrame:
    targets = [(i, j, float(p)) for i in range(len(columns)) for j, p in enumerate(probs)]
    value = {i: F.col(f"`{c}`") for i, c in enumerate(columns)}

    def with_params(df: DataFrame, params: DataFrame) -> DataFrame:
        return attach(df, params, by) if by else beside(df, params)

    # 1. Bracket every target by quantiles of a sample of each group.
    sized = with_params(work, sizes)
    sample = sized.filter(F.rand(SAMPLE_SEED) < sample_rows / F.col("_rows"))

    def edges(i: int) -> list[float]:
        """Sample positions of column i's brackets, kept within [0, 1]."""
        at = [p + side * 5 * math.sqrt(max(p * (1 - p), 1e-4) / sample_rows) * width
              for k, _, p in targets if k == i for side in (-1, 1)]
        return [min(max(a, 0.0), 1.0) for a in at]

    def bracket(i: int, j: int, side: int) -> Column:
        at = edges(i)[2 * j + (side + 1) // 2]
        open_end = F.lit(float("inf") * side)
        return open_end if at in (0.0, 1.0) else F.coalesce(F.col(f"_s{i}")[2 * j + (side + 1) // 2], open_end)

    def first_rank(i: int, p: float) -> Column:
        return F.floor((F.col(f"_n{i}") - 1) * F.lit(p)) + 1

    width = 1.0
    while True:
        brackets = sample.groupBy(*by).agg(
            *[F.percentile(value[i], F.array(*map(F.lit, edges(i)))).alias(f"_s{i}") for i in value]
        )
        brackets = with_params(sizes, brackets)
        brackets = brackets.select(
            *sizes.columns,
            *[bracket(i, j, side).alias(f"_{tag}{i}_{j}") for i, j, _ in targets for tag, side in (("lo", -1), ("hi", 1))],
        )
        brackets = pin(brackets) or write_out(brackets, "brackets")
        placed = with_params(work, brackets)
        # 2. Count what lies below and inside, and prove the bracket.
        counted = placed.groupBy(*by).agg(
            *[F.count_if(value[i] < F.col(f"_lo{i}_{j}")).alias(f"_below{i}_{j}") for i, j, _ in targets],
            *[
                F.count_if(value[i].between(F.col(f"_lo{i}_{j}"), F.col(f"_hi{i}_{j}"))).alias(f"_in{i}_{j}")
                for i, j, _ in targets
            ],
        )
        counted = with_params(brackets, counted)
        counted = pin(counted) or write_out(counted, "counts")
        missed = F.lit(False)
        for i, j, p in targets:
            last = F.least(first_rank(i, p) + 1, F.col(f"_n{i}"))
            below = F.col(f"_below{i}_{j}")
            missed |= (F.col(f"_n{i}") > 0) & ((first_rank(i, p) <= below) | (last > below + F.col(f"_in{i}_{j}")))
        if counted.filter(missed).isEmpty():
            break
        width *= 4

    # 3. Shuffle only the values inside, one row per distinct value. A bracket that has
    # shrunk to a single (often hot) value needs none: that value is the answer.
    inside = placed.select(
        *by,
        F.inline(
            F.array_compact(
                F.array(
                    *[
                        F.when(
                            value[i].between(F.col(f"_lo{i}_{j}"), F.col(f"_hi{i}_{j}"))
                            & (F.col(f"_lo{i}_{j}") < F.col(f"_hi{i}_{j}")),
                            F.struct(F.lit(i).alias("_i"), F.lit(j).alias("_j"), value[i].alias("_v")),
                        )
                        for i, j, _ in targets
                    ]
                )
            )
        ),
    )
    inside = write_out(inside.groupBy(*by, "_i", "_j", "_v").agg(F.count("*").alias("_k")), "inside")
    keys = [*by, "_i", "_j"]
    ranked = running_total(inside, keys, ["_v"], "_k", "_upto", inside.count(), window_rows)

    # 4. Pick the two neighbouring order statistics and interpolate.
    wanted = counted.select(
        *by,
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("_i"), F.lit(j).alias("_j"), F.col(f"_n{i}").alias("n"),
                        (F.col(f"_n{i}") - 1).cast("double").alias("_top"), F.lit(p).alias("_p"),
                        F.col(f"_below{i}_{j}").alias("_below"),
                        F.when(F.col(f"_lo{i}_{j}") == F.col(f"_hi{i}_{j}"), F.col(f"_lo{i}_{j}")).alias("_only"),
                    )
                    for i, j, p in targets
                ]
            )
        ),
    )
    wanted = wanted.withColumn("_pos", F.greatest(F.col("_top") * F.col("_p"), F.lit(0.0)))
    hit = attach(ranked, wanted, keys).withColumn("_upto", F.col("_upto") + F.col("_below"))
    from_rank = F.col("_upto") - F.col("_k")

    def at_rank(rank: Column) -> Column:
        return F.max(F.when((from_rank < rank) & (rank <= F.col("_upto")), F.col("_v")))

    low, high = F.floor("_pos") + 1, F.ceil("_pos") + 1
    picked = hit.groupBy(*keys).agg(
        at_rank(low).alias("_a"), at_rank(high).alias("_b"), F.max(F.col("_pos") - F.floor("_pos")).alias("_f")
    )
    picked = attach(wanted.select(*keys, "n", "_only"), picked, keys).withColumn(
        "_q", F.coalesce("_only", F.col("_a") * (1 - F.col("_f")) + F.col("_b") * F.col("_f"))
    )
    names = F.array(*[F.lit(c) for c in columns])
    return (
        picked.groupBy(*by, "_i")
        .agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("_j", "_q"))).alias("_qs"))
        .select(
            *by,
            F.element_at(names, F.col("_i") + 1).alias("column_name"),
            "n",
            F.when(F.col("n") > 0, F.transform("_qs", lambda s: s["_q"])).alias("q"),
        )
    )


def quantile_values(df: DataFrame, columns: Sequence[str], probs: Sequence[float], **options) -> dict[str, list]:
    """Whole-table quantiles as Python floats: one short list per column."""
    rows = exact_quantiles(df, columns, probs, **options).collect()
    return {r["column_name"]: list(r["q"]) if r["q"] is not None else [None] * len(probs) for r in rows}


def rank_cuts(
    df: DataFrame, by: str | None, key: str, tie: str, ranks: dict, sizes: dict, window_rows: int | None = None
) -> dict[object, list[tuple]]:
    """The (key, tie) of the rows that hold given ranks, per group.

    ``key`` is a uniform 60-bit hash and ``sizes`` the rows per group. Because the key is
    uniform, rank r of n lies near r/n of its range, so the bracket needs no sample:
    sixteen standard deviations hold about 16 sqrt(n) rows, which are the only ones
    ranked, and the count below proves the bracket. Groups that fit a window are taken
    whole. The answer is as small as the question: one pair per rank.
    """
    window_rows = window_rows or WINDOW_ROWS
    spark, top = df.sparkSession, 2**KEY_BITS
    asked = [(g, cut, r) for g, rs in ranks.items() for cut, r in enumerate(rs)]
    if not asked:
        return {g: [] for g in ranks}
    on = [by] if by is not None else []
    group = [df.schema[by]] if by is not None else []
    bigint = T.LongType()
    hung_schema = T.StructType(
        [*group, T.StructField("_cuts", T.ArrayType(T.StructType([T.StructField(f, bigint) for f in ("cut", "_lo", "_hi")])))]
    )
    rows = df.select(*on, F.col(key).alias("_key"), F.col(tie).alias("_tie"))
    width = 1
    while True:
        brackets = {}
        for g, cut, r in asked:
            n = sizes[g]
            if n <= window_rows:
                brackets[g, cut] = (0, top)
                continue
            share = r / n
            sigma = math.sqrt(max(share * (1 - share), 1 / n) / n)
            reach = (8 * sigma + 64 / n) * width
            brackets[g, cut] = (int(max(share - reach, 0.0) * top), int(min(share + reach, 1.0) * top))
        hung = {g: [(cut, *brackets[g, cut]) for h, cut, _ in asked if h == g] for g in ranks}
        table = local_table(spark, [((g,) if on else ()) + (cuts,) for g, cuts in hung.items() if cuts], hung_schema)
        held = attach_local(rows, table, on, how="inner") if on else beside(rows, table)
        near = held.select(*on, "_key", "_tie", F.inline("_cuts")).filter(F.col("_key") <= F.col("_hi"))
        if max(sizes[g] for g, _, _ in asked) <= window_rows:
            below = {place: 0 for place in brackets}
            inside = sum(sizes[g] for g, _, _ in asked)
            break
        counted = near.groupBy(*on, "cut").agg(
            F.count_if(F.col("_key") < F.col("_lo")).alias("below"), F.count("*").alias("upto")
        )
        counts = {((c[by] if on else None), c["cut"]): (c["below"], c["upto"]) for c in counted.collect()}
        if all(counts.get((g, cut), (0, 0))[0] < r <= counts.get((g, cut), (0, 0))[1] for g, cut, r in asked):
            below = {place: b for place, (b, _) in counts.items()}
            inside = sum(u - b for b, u in counts.values())
            break
        if width > 2**40:
            raise ValueError("some rank lies beyond its group")
        width *= 8
    places = local_table(
        spark,
        [((g,) if on else ()) + (cut, r - below[g, cut]) for g, cut, r in asked],
        T.StructType([*group, T.StructField("cut", bigint), T.StructField("_wanted", bigint)]),
    )
    inner = near.filter(F.col("_key") >= F.col("_lo")).select(*on, "cut", "_key", "_tie")
    ranked = rank_rows(inner, [*on, "cut"], ["_key", "_tie"], "_rank", inside, window_rows)
    found = attach_local(ranked, places, [*on, "cut"], how="inner").filter(F.col("_rank") == F.col("_wanted"))
    edges: dict[object, list] = {g: [] for g in ranks}
    for row in found.orderBy(*on, "cut").collect():
        edges[row[by] if on else None].append((row["_key"], row["_tie"]))
    return edges
