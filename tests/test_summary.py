"""The profile in two readings, against pandas, and how often it reads."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import summary


def frame(n=4000, seed=1):
    r = np.random.default_rng(seed)
    return pd.DataFrame({
        "normal": r.normal(0, 1, n), "skewed": r.exponential(1, n) ** 3, "few": r.integers(0, 4, n).astype(float), "same": np.full(n, 2.5),
        "gaps": np.where(r.random(n) < 0.3, np.nan, r.normal(5, 2, n)), "whole": r.integers(-10**6, 10**6, n), "gone": np.full(n, np.nan),
        "heavy": np.where(r.random(n) < 0.6, 1.0, r.normal(0, 50, n)),
    })


def check(pdf, found):
    for r in found.collect():
        x = pdf[r.column_name].dropna()
        assert r.missing == len(pdf) - len(x) and r.rows == len(pdf)
        if x.empty:
            assert r.q1 is None and r.outliers_below is None
            continue
        q = x.quantile([0.25, 0.5, 0.75]).tolist()
        reach = 1.5 * (q[2] - q[0])
        assert [r.q1, r.median, r.q3] == pytest.approx(q, rel=1e-12, abs=1e-12)
        assert (r.outliers_below, r.outliers_above) == ((x < q[0] - reach).sum(), (x > q[2] + reach).sum())
        assert [r["mean"], r["std"], r["min"], r["max"]] == pytest.approx([x.mean(), x.std(), x.min(), x.max()], rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("k", [1024, 20])  # a coarse sketch gives wide brackets and the same answer
def test_against_pandas(spark, k):
    pdf = frame()
    check(pdf, summary.whole_profile(spark.createDataFrame(pdf), k=k, window_rows=300))


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    monkeypatch.setattr(summary, "rank_error", lambda k: 1e-6)
    pdf = frame(2000)
    check(pdf, summary.whole_profile(spark.createDataFrame(pdf).repartition(4), k=8))


def test_reads_a_table_twice(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    pdf = frame(3000)
    df = spark.createDataFrame(pdf)
    df = df.mapInArrow(counted, df.schema)
    assert summary.whole_profile(df).count() == 8
    assert read.value == 2 * 3000


def test_odd_tables(spark):
    assert summary.whole_profile(spark.createDataFrame([("a",)], "t string")).collect() == []
    none = summary.whole_profile(spark.createDataFrame([], "x double")).first()
    assert none.rows == 0 and none.q1 is None
    one = summary.whole_profile(spark.createDataFrame([(3.0, 1), (None, None)], "`a.b` double, n int"), ["a.b", "n", "no"]).collect()
    assert [(r.column_name, r.median, r.outliers_above, r.missing_pct) for r in one] == [("a.b", 3.0, 0, 50.0), ("n", 1.0, 0, 50.0)]
