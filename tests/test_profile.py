import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.functions import columns as C
from riskloom.functions.scalars import chi2_upper_tail, digamma, fixed
from riskloom.operators import profile, relation


@pytest.fixture(scope="module")
def pdf():
    r = np.random.default_rng(3)
    x = r.gamma(2.0, 20.0, 90)
    x[::9] = np.nan
    return pd.DataFrame({"Sample_ID": [f"s{i}" for i in range(90)], "x": x, "y": 3 * x + r.normal(0, 5, 90), "k": r.choice(["u", "v"], 90), "n": r.integers(0, 9, 90)})


@pytest.fixture(scope="module")
def df(spark, pdf):
    return spark.createDataFrame(pdf)


def test_column_choice(df):
    assert C.numeric_columns(df) == ["x", "y", "n"]
    assert C.without_identifiers(C.string_columns(df)) == ["k"]
    assert C.core_columns(df) == ["x", "y", "n"]
    narrow = df.withColumn("small", F.lit(1)).withColumn("flag", F.lit(True))
    narrow = narrow.withColumns({k: F.lit(2).cast(k) for k in ("float", "decimal(9,2)", "smallint", "tinyint")})
    assert C.numeric_columns(narrow) == ["x", "y", "n", "small", "float", "decimal(9,2)", "smallint", "tinyint"]


def test_nan_counts_as_missing(df, pdf):
    rows = {r["column_name"]: r for r in profile.null_profile(df).collect()}
    assert rows["x"]["missing"] == pdf.x.isna().sum() and rows["x"]["missing_pct"] == round(100 * pdf.x.isna().mean(), 2)
    assert rows["k"]["type"] == "object" and rows["n"]["type"] == "int64"
    quality = profile.table_quality(df).first()
    assert quality["missing_cells"] == pdf.isna().sum().sum() and quality["numeric_columns"] == 3


def test_describe_equals_pandas(df, pdf):
    want = pdf.describe()
    for row in profile.describe(df).collect():
        got = [row[m] for m in ("count", "mean", "std", "min", "q1", "median", "q3", "max")]
        assert np.allclose(got, want[row["column_name"]].to_numpy())


def test_distribution(df, pdf):
    got = {r["statistic"]: r["value"] for r in profile.distribution_stats(df, "x").collect()}
    assert math.isclose(got["Skewness"], pdf.x.skew()) and math.isclose(got["Median"], pdf.x.median())
    assert got["Count"] == pdf.x.count()


@pytest.mark.parametrize("values", [[1.0, 2.0], [4.0] * 5, [1.0, 2.0, 9.0], [None, None, None]])
def test_skewness_edges(spark, values):
    got = relation.skewness(spark.createDataFrame([(v,) for v in values], "x double"), ["x"]).first()["skewness"]
    want = pd.Series(values, dtype=float).skew()
    assert got is None if np.isnan(want) else math.isclose(got, want)


def test_bands_cover_everything(spark):
    df = spark.createDataFrame([(v,) for v in [-5.0, 24.9, 25.0, 75.0, 300.0, None]], "x double")
    got = {r["band"]: r["n"] for r in profile.score_bands(df, "x").collect()}
    assert got == {"0-25": 2, "25-50": 1, "50-75": 0, "75-100": 2}


def test_duplicates(spark):
    rows = [(1, None), (1, None), (1, float("nan")), (2, 3.0), (2, 3.0), (2, 3.0)]
    assert profile.duplicate_rows(spark.createDataFrame(rows, "a int, b double")).first()[0] == 3
    assert profile.duplicate_rows(spark.createDataFrame([], "a int")).first()[0] == 0


def test_coercion_equals_pandas(spark):
    texts = ["1", " 2 ", "1e3", "inf", "", "abc", None, "nan", "-0.5"]
    got = C.coerce_numeric(spark.createDataFrame([(t,) for t in texts], "x string"), ["x"]).toPandas().x
    want = pd.to_numeric(pd.Series(texts), errors="coerce")
    assert np.array_equal(got.to_numpy(float), want.to_numpy(float), equal_nan=True)


def test_trend_and_correlation(df, pdf):
    keep = pdf.dropna()
    slope, intercept = np.polyfit(keep.x, keep.y, 1)
    row = relation.trend_line(df, "x", "y").first()
    assert np.allclose([row["slope"], row["intercept"]], [slope, intercept])
    assert math.isclose(relation.correlation(df, "x", "y").first()[0], keep.x.corr(keep.y))
    assert relation.trend_line(df, "x", "y", "k").count() == 2
    assert relation.scatter_pairs(df, "x", "y", "none").columns == ["x", "y"]


def test_box_of_groups(df, pdf):
    for row in relation.box_stats(df, "x", "k", group_cells=5, sample_rows=20).collect():
        x = pdf[pdf.k == row["k"]].x.dropna()
        q1, q3 = x.quantile(0.25), x.quantile(0.75)
        inside = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
        assert np.allclose([row["q1"], row["q3"], row["whisker_low"], row["whisker_high"]], [q1, q3, inside.min(), inside.max()])
        assert row["outliers"] == len(x) - len(inside)
    assert relation.box_stats(df, "x").first()["n"] == pdf.x.count()


def test_histogram(spark, df, pdf):
    bins = relation.histogram(df, "x").orderBy("bin").toPandas()
    want, _ = np.histogram(pdf.x.dropna(), bins=30)
    assert (bins.n == want).all()
    flat = relation.histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x")
    assert flat.agg(F.sum("n")).first()[0] == 2
    assert relation.histogram(spark.createDataFrame([], "x double"), "x").count() == 0


def test_target_kinds(df):
    assert {r["category"] for r in profile.target_profile(df, "k").collect()} == {"u", "v"}
    row = profile.target_profile(df, "y").first()
    assert row["model_type"] == "Regression" and row["category"] is None
    assert profile.target_profile(df, "n").first()["kind"] == "Categorical"


def test_special_functions(spark):
    got = spark.range(1, 200).select("id", digamma(F.col("id")).alias("p")).toPandas()
    want = [-0.5772156649015329 + sum(1 / k for k in range(1, n)) for n in got.id]
    assert np.allclose(got.p, want, atol=1e-9)
    # Known points of the chi-squared upper tail: 5 % and 1 % critical values.
    rows = [(3.841458821, 1, 0.05), (5.991464547, 2, 0.05), (7.814727903, 3, 0.05), (13.27670414, 4, 0.01), (15.08627247, 5, 0.01)]
    df = spark.createDataFrame(rows, "s double, d int, want double")
    assert all(math.isclose(r[0], r[1], rel_tol=1e-6) for r in df.select(chi2_upper_tail("s", "d"), "want").collect())


def test_fixed_text_equals_python(spark):
    values = [0.00005, -70.45375, 157.13625, 2.5, 0.125, 1e16 + 2, -1e-9, 123456.00015, 0.0, 99.95, None, 1 / 3]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for places in (0, 1, 2, 4):
        got = [r[0] for r in df.select(fixed(F.col("x"), places)).collect()]
        assert got == [None if v is None else f"{v:.{places}f}" for v in values]


def test_head_is_ordered(df):
    assert [r["Sample_ID"] for r in profile.head(df, ["Sample_ID"], 3).collect()] == ["s0", "s1", "s10"]
