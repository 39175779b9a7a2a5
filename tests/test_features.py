import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from riskloom.operators import encode, impute, outliers, ranking, transform
from riskloom.plans import presets
from riskloom.plans.feature_selection import ranking_input, select_features

few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
numbers = st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6)), min_size=1, max_size=40)


def frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, x double")


@few
@given(numbers)
def test_capped_values_lie_inside(spark, values):
    df = frame(spark, values)
    got = outliers.cap_outliers(df, ["x"]).toPandas().sort_values("id").x
    x = pd.Series(values, dtype=float)
    q1, q3 = x.quantile(0.25), x.quantile(0.75)
    want = x.clip(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    assert np.allclose(got.to_numpy(float), want.to_numpy(), equal_nan=True, rtol=1e-9, atol=1e-6)


@few
@given(numbers)
def test_scaling(spark, values):
    df = frame(spark, values)
    step = transform.fit_standard_scale(df, ["x"])
    got = step.apply(df).toPandas().sort_values("id").x.to_numpy(float)
    x = pd.Series(values, dtype=float)
    if x.std(ddof=0) > 1e-6:
        assert np.allclose(got, ((x - x.mean()) / x.std(ddof=0)).to_numpy(), equal_nan=True, atol=1e-6)
    assert np.isnan(got).sum() == x.isna().sum()


def test_constant_and_missing_columns_scale(spark):
    df = spark.createDataFrame([(5.0, None), (5.0, None)], "a double, b double")
    assert transform.fit_standard_scale(df, ["a", "b"]).apply(df).collect() == [(0.0, None), (0.0, None)]


def test_log_shift(spark):
    df = spark.createDataFrame([(0.0, -3.0, 2.0), (9.0, 4.0, 5.0)], "zero double, below double, above double")
    got = transform.fit_log_transform(df, ["zero", "below", "above"]).apply(df).first()
    assert np.allclose(got, [math.log1p(1), math.log1p(1), math.log1p(2)])
    even = spark.createDataFrame([(float(i),) for i in range(20)], "x double")
    assert transform.fit_log_transform(even, ["x"], only_skewed=True).params == {}


def test_outlier_report(spark):
    df = spark.createDataFrame([(float(v), None, "t") for v in [*range(20), 500, -400]], "x double, gone double, text string")
    rows = outliers.detect_outliers(df, ["x", "gone", "text"]).collect()
    assert [r["column_name"] for r in rows] == ["x"]
    assert (rows[0]["outliers_below"], rows[0]["outliers_above"], rows[0]["outlier_count"]) == (1, 1, 2)
    assert outliers.outlier_table(outliers.detect_outliers(df, ["x"])).first()["pct"] == "9.1%"
    after = {r["stage"]: r for r in outliers.cap_stats(df, ["x"]).collect()}
    assert after["after"]["max"] < after["before"]["max"] and after["after"]["outlier_count"] == 2
    assert outliers.detect_outliers(df, ["gone"]).count() == 0


def test_one_hot(spark):
    df = spark.createDataFrame([(1, "b", "s1", 7.5), (2, "a", "s2", None), (3, None, "s3", 7.5)], "n long, k string, Sample_ID string, pH double")
    out = encode.one_hot(df)
    assert out.columns == ["n", "Sample_ID", "pH", "k_a", "k_b"]
    assert [(r["k_a"], r["k_b"]) for r in out.orderBy("n").collect()] == [(0, 1), (1, 0), (0, 0)]
    listed = encode.one_hot(df, encode.listed_categories(df))
    assert listed.columns[-1] == "pH_7.5" and listed.orderBy("n").first()["pH_7.5"] == 1
    with pytest.raises(ValueError):
        encode.one_hot(df, ["Sample_ID"], max_categories=2)
    assert encode.one_hot(df.select("n")).columns == ["n"]


@pytest.mark.parametrize("window_rows", [1 << 20, 7])
def test_label_codes(spark, window_rows):
    values = [f"v{i % 50:02d}" if i % 11 else None for i in range(400)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, k string")
    got = encode.label_encode(df, "k", name="code", missing="nan", window_rows=window_rows).toPandas().sort_values("id")
    names = sorted({v or "nan" for v in values})
    assert list(got.code) == [names.index(v or "nan") for v in values]
    plain = encode.label_encode(df, "k").toPandas()
    assert plain.k.isna().sum() == values.count(None)


def test_numeric_labels_keep_their_order(spark):
    df = spark.createDataFrame([(10,), (2,), (2,)], "y long")
    assert sorted(r["y"] for r in encode.label_encode(df, "y").collect()) == [0, 0, 1]


@pytest.mark.parametrize("values", [list(range(17)), [0, 0, 0, 1, 2, 3, 4, 5], [0, 0, 0, 0, 0, 0, 1]])
def test_quantile_bins_equal_pandas(spark, values):
    df = frame(spark, [float(v) for v in values] + [None])
    got = impute.quantile_bin(df, "x").toPandas().sort_values("id")["bin"].to_numpy(float)
    want = pd.qcut(pd.Series([*values, np.nan], dtype=float), 4, labels=False, duplicates="drop").to_numpy(float)
    assert np.array_equal(got, want, equal_nan=True)


def test_imputation(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None), (4.0, None), (None, None)], "x double, gone double")
    assert impute.fit_median(df, ["x", "gone"]).apply(df).filter("x = 2.5").count() == 1
    assert impute.fit_mean(df, ["x"]).apply(df).filter("x = 2.5").count() == 1
    assert impute.drop_null_columns(df.fillna(0.0, ["x"])).columns == ["x"]


def test_preset_order(spark):
    df = spark.createDataFrame([(float(i * i), "a" if i % 2 else "b") for i in range(30)], "Risk_Score double, Location string")
    got = presets.preprocess(df, "scale_log").toPandas().Risk_Score.to_numpy()
    x = np.array([float(i * i) for i in range(30)])
    z = (x - x.mean()) / x.std()
    assert np.allclose(np.sort(got), np.log1p(z + abs(z.min()) + 1))
    assert presets.preprocess(df, "full").columns == ["Risk_Score", "Location_a", "Location_b"]
    assert presets.preprocess(df, ["log"]).columns == df.columns


def brute_mutual_info(x, y, k=3):
    psi = lambda n: -0.5772156649015329 + sum(1 / i for i in range(1, n))
    sizes = pd.Series(y).value_counts()
    keep = np.array([sizes[c] > 1 for c in y])
    x, y = x[keep], y[keep]
    total = []
    for i in range(len(x)):
        d = np.abs(x - x[i])
        own = np.sort(np.delete(d, i)[np.delete(y == y[i], i)])
        ki = min(k, len(own))
        r = own[ki - 1]
        total.append(psi(ki) - psi(len(own) + 1) - psi(int(((d < r) | (d == 0)).sum())))
    return max(0.0, psi(len(x)) + float(np.mean(total)))


@pytest.mark.parametrize("window_rows", [1 << 20, 40])
def test_mutual_info(spark, window_rows):
    r = np.random.default_rng(1)
    y = r.choice(["a", "b", "c"], 300, p=[0.7, 0.2, 0.1])
    x = np.where(y == "a", 0.0, 2.0) + r.normal(0, 1, 300)
    y[0], y[1:3] = "only", "pair"  # a class of one is left out, a class of two has one neighbour
    df = spark.createDataFrame([(i, float(x[i]), float(r.normal()), y[i]) for i in range(300)], "id long, x double, noise double, y string")
    got = {r["feature"]: r["mutual_info"] for r in ranking.mutual_info(df, ["x", "noise"], "y", "id", window_rows=window_rows).collect()}
    assert math.isclose(got["x"], brute_mutual_info(x, y), abs_tol=1e-6)
    assert got["x"] > got["noise"]


def test_mutual_info_with_many_copies(spark):
    """A third of all rows share one value; the jitter keeps the estimate near that of a coin."""
    df = spark.range(3_000).select("id", F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.rand(5)).alias("x"), (F.xxhash64("id") % 2).alias("y"))
    one = ranking.mutual_info(df, ["x"], "y", "id").first()["mutual_info"]
    many = ranking.mutual_info(df, ["x"], "y", "id", window_rows=500).first()["mutual_info"]
    assert one < 0.05 and math.isclose(one, many, rel_tol=1e-9, abs_tol=1e-12)


def test_chi2(spark):
    r = np.random.default_rng(2)
    y = r.choice(["a", "b", "c", "d"], 80)
    x = r.normal(0, 3, 80)
    df = spark.createDataFrame([(float(v), c) for v, c in zip(x, y)], "x double, y string")
    z = x - x.min() + 1
    want = sum((z[y == c].sum() - (y == c).mean() * z.sum()) ** 2 / ((y == c).mean() * z.sum()) for c in "abcd")
    row = ranking.chi2_scores(df, ["x"], "y").first()
    assert math.isclose(row["chi2_score"], want, rel_tol=1e-9) and 0 < row["p_value"] < 1


def test_feature_selection(spark):
    df = spark.range(400).select(
        "id", F.when(F.col("id") % 2 == 0, 5.0).otherwise(0.0).alias("good"), F.rand(1).alias("bad"),
        F.lit(None).cast("double").alias("gone"), (F.col("id") % 2).cast("double").alias("y"),
    )
    rows, names = ranking_input(df, "y", "id")
    assert names == ["good", "bad"]
    assert select_features(df.withColumn("y", F.col("y").cast("string")), "y", "id", keep=1, trees=5) == ["good"]
