"""Statistics kept by part: merging, errors, and what an appended part costs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import stored


def days(spark, count=6, rows=3000, seed=1):
    r = np.random.default_rng(seed)
    pdf = pd.DataFrame({
        "day": np.repeat([f"2024-0{k + 1}" for k in range(count)], rows), "x": r.lognormal(0, 2, count * rows), "n": r.integers(0, 700, count * rows),
        "t": [f"w{k}" for k in r.integers(0, 90, count * rows)],
    })
    pdf.loc[::17, "x"] = np.nan
    return pdf


def test_parts_merge(spark, tmp_path):
    pdf, path = days(spark), str(tmp_path / "store")
    df = spark.createDataFrame(pdf)
    stored.store_parts(df.where("day <> '2024-06'"), path, "day")
    before = {r.column_name: r.rows for r in stored.merged(stored.stored(spark, path)).collect()}
    assert before == {"x": 15_000, "n": 15_000, "t": 15_000}
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    late = df.where("day = '2024-06'").drop("day")
    for _ in range(2):  # the second time replaces the first
        stored.store_part(late.mapInArrow(counted, late.schema), path, "2024-06")
    assert read.value == 2 * 3000  # what is in the store is not read again
    rows = stored.stored(spark, path)
    assert rows.select("part").distinct().count() == 6
    for r in stored.merged(rows).collect():
        x = pdf[r.column_name].dropna()
        assert (r.rows, r.n) == (len(pdf), len(x))
        if r.column_name != "t":
            assert [r["mean"], r["std"], r["min"], r["max"]] == pytest.approx([x.mean(), x.std(), x.min(), x.max()])
    one = stored.merged(stored.stored(spark, path, ["2024-02", "2024-03"])).where("column_name = 'x'").first()
    some = pdf[pdf.day.isin(["2024-02", "2024-03"])].x.dropna()
    assert one["mean"] == pytest.approx(some.mean()) and one.n == len(some)


def test_errors_are_within_their_bounds(spark, tmp_path):
    pdf, path = days(spark, 9, 4000, 3), str(tmp_path / "store")
    stored.store_parts(spark.createDataFrame(pdf), path, "day")
    rows, probs = stored.stored(spark, path), [0.0, 0.01, 0.1, 0.5, 0.75, 0.99, 1.0]
    x = np.sort(pdf.x.dropna().to_numpy())
    found = stored.approximate_quantiles(rows.where("column_name = 'x'"), probs).collect()
    assert [r.p for r in found] == probs
    for r in found:
        rank = np.searchsorted(x, r.value) / len(x)
        assert abs(rank - r.p) <= stored.rank_error(stored.QUANTILE_K) + 1 / len(x)
        assert r.low <= np.quantile(x, r.p) <= r.high or r.p in (0.0, 1.0)
    for r in stored.approximate_distinct(rows).collect():
        exact = pdf[r.column_name].nunique()
        assert r.low <= exact <= r.high and abs(r.n_distinct - exact) <= stored.distinct_error() * exact


def test_odd_parts(spark, tmp_path):
    path = str(tmp_path / "store")
    odd = spark.createDataFrame([(None, None, -0.0), (None, "a", 0.0), ("p/q=1 x", None, float("nan"))], "part string, t string, `a.b` double")
    stored.store_parts(odd, path, "part")
    rows = stored.stored(spark, path)
    assert {r.part for r in rows.collect()} == {None, "p/q=1 x"}
    found = {r.column_name: (r.n, r.n_distinct) for r in stored.approximate_distinct(rows).collect()}
    assert found == {"t": (1, 1), "a.b": (2, 1)}
    assert stored.approximate_quantiles(rows, [0.5]).first().value == 0.0
    empty = str(tmp_path / "empty")
    stored.store_part(odd.limit(0), empty, "none")
    assert stored.approximate_quantiles(stored.stored(spark, empty), [0.5]).collect() == []
    with pytest.raises(ValueError):
        stored.store_part(odd.select(F.lit(True).alias("b")), empty, "x")
