"""Quantiles, ranks and running totals: the paths for large groups against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.functions.scalars import hash_key
from riskloom.operators import lookup
from riskloom.operators.ordering import rank_rows, running_total
from riskloom.operators.quantiles import exact_quantiles, quantile_values, rank_cuts

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
# Sizes that send every group through the bracketing path.
LARGE = {"group_cells": 10, "sample_rows": 500, "window_rows": 100}


@pytest.fixture(scope="module")
def frame():
    r = np.random.default_rng(7)
    n = 6_000
    return pd.DataFrame(
        {
            # One group holds a third of all rows; one is tiny; one key is missing.
            "g": r.choice(["hot", "a", "b", "c", None], n, p=[0.4, 0.25, 0.2, 0.1, 0.05]),
            "tied": r.choice([0.0, 1.0, 2.5, 7.0], n, p=[0.5, 0.3, 0.15, 0.05]),
            "wide": np.where(r.random(n) < 0.05, np.nan, r.standard_cauchy(n) * 1e3),
            "ints": r.integers(-50, 50, n),
            "gone": np.full(n, np.nan),
        }
    )


COLUMNS = ["tied", "wide", "ints", "gone"]


@pytest.mark.parametrize("options", [{}, LARGE], ids=["built-in", "bracketed"])
def test_whole_table(spark, frame, options):
    got = quantile_values(spark.createDataFrame(frame), COLUMNS, PROBS, **options)
    for c in COLUMNS[:-1]:
        assert np.allclose(got[c], frame[c].quantile(PROBS).to_numpy(), rtol=1e-12, atol=1e-12), c
    assert got["gone"] == [None] * len(PROBS)


@pytest.mark.parametrize("options", [{}, LARGE, {**LARGE, "group_cells": 3_000}], ids=["built-in", "bracketed", "mixed"])
def test_by_group(spark, frame, options):
    rows = exact_quantiles(spark.createDataFrame(frame), COLUMNS, PROBS, by=["g"], **options).collect()
    assert len(rows) == 5 * len(COLUMNS)
    for row in rows:
        part = frame[frame.g.isna() if row["g"] is None else frame.g == row["g"]][row["column_name"]]
        assert row["n"] == part.count()
        if row["n"]:
            assert np.allclose(row["q"], part.quantile(PROBS).to_numpy(), rtol=1e-12, atol=1e-12)
        else:
            assert row["q"] is None


def test_poor_sample_is_noticed(spark, frame):
    """A sample of a handful of rows brackets badly; the count widens it until it holds."""
    got = quantile_values(spark.createDataFrame(frame), ["wide"], [0.5, 0.999], group_cells=1, sample_rows=6)
    assert np.allclose(got["wide"], frame["wide"].quantile([0.5, 0.999]).to_numpy())


def test_empty_table(spark):
    empty = spark.createDataFrame([], "x double")
    assert quantile_values(empty, ["x"], [0.5]) == {"x": [None]}


def test_running_total_in_slices(spark, frame):
    pdf = frame[["g", "ints"]].assign(id=range(len(frame)), one=1)
    df = spark.createDataFrame(pdf)
    got = running_total(df, ["g"], ["ints", "id"], "one", "upto", len(pdf), window_rows=700).toPandas()
    pdf = pdf.sort_values(["ints", "id"])
    pdf["want"] = pdf.groupby("g", dropna=False).cumcount() + 1
    both = got.merge(pdf[["id", "want"]], on="id")
    assert len(both) == len(pdf) and (both.upto == both.want).all()


def test_rank_without_groups(spark):
    df = spark.range(1_000).select((F.col("id") * 7 % 1_000).alias("x"))
    ranked = rank_rows(df, [], ["x"], "r", 1_000, window_rows=90).toPandas()
    assert (ranked.r == ranked.x + 1).all()


@pytest.mark.parametrize("window_rows", [None, 50])
def test_rank_cuts(spark, window_rows):
    df = spark.range(20_000).select("id", (F.col("id") % 3 == 0).cast("int").alias("c"), hash_key(F.col("id"), 1).alias("k"))
    sizes = {r["c"]: r["count"] for r in df.groupBy("c").count().collect()}
    ranks = {0: [1, 5_000, sizes[0]], 1: [17]}
    got = rank_cuts(df, "c", "k", "id", ranks, sizes, window_rows)
    pdf = df.toPandas().sort_values(["k", "id"])
    for c, rs in ranks.items():
        part = pdf[pdf.c == c]
        assert got[c] == [(part.k.iloc[r - 1], part.id.iloc[r - 1]) for r in rs]


def test_attach_beyond_broadcast(spark, monkeypatch):
    """A lookup table over the limit is shuffled, its hot keys broadcast; no row is lost."""
    monkeypatch.setattr(lookup, "PIN_ROWS", 5)
    monkeypatch.setattr(lookup, "HOT_SHARE", 4)
    df = spark.range(3_000).select("id", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 40).alias("k"))
    table = df.groupBy("k").agg(F.count("*").alias("n"))
    out = lookup.attach(df, table, ["k"], weight="n").toPandas()
    want = df.toPandas().fillna(-1).groupby("k").id.transform("count")
    assert len(out) == 3_000
    out = out.sort_values("id").reset_index(drop=True)
    assert (out.n == want).all()
