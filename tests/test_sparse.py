"""Models on one-hot features: sparse columns give what the dense ones give."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import boosting, encode, models
from riskloom.plans import training


def frame(n=600, seed=1):
    r = np.random.default_rng(seed)
    city = r.choice([f"c{k:02d}" for k in range(12)], n)
    kind = np.where(r.random(n) < 0.1, None, r.choice(["x", "y", "z"], n))
    size = np.round(r.normal(0, 1, n), 1)
    label = ((city < "c05").astype(int) + (kind == "x") + (size > 0.5)) % 3
    return pd.DataFrame({"id": np.arange(n), "size": size, "city": city, "kind": kind, "y": [f"k{v}" for v in label]})


def test_codes_follow_the_layout(spark):
    df = spark.createDataFrame(frame())
    coded, sizes = encode.sparse_codes(*encode.one_hot_sparse(df, ["city", "kind"]))
    assert sizes == {"city_code": 12, "kind_code": 3}
    both = coded.join(df.select("id", "city", "kind"), "id").collect()
    assert all(r.city_code == int(r.city[1:]) and r.kind_code == (None if r.kind is None else "xyz".index(r.kind)) for r in both)


def dense_and_sparse(spark):
    df = spark.createDataFrame(frame())
    coded, sizes = encode.sparse_codes(*encode.one_hot_sparse(df, ["city", "kind"]))
    sparse, classes = models.prepare(coded, "y", ["size"], "id", codes_of=sizes)
    wide = encode.one_hot(df, ["city", "kind"])
    names = ["size", *[c for c in wide.columns if c.startswith(("city_", "kind_"))]]
    dense, _ = models.prepare(wide, "y", names, "id")
    return sparse, dense, len(names), classes, list(sizes.values())


def test_predictions_equal_the_dense_ones(spark):
    sparse, dense, width, classes, codes = dense_and_sparse(spark)
    settings = models.ModelSettings(rounds=8, trees=10, depth=6, logistic_iterations=200)
    one = models.fit_all(sparse, 1, len(classes), settings, codes=codes)
    two = models.fit_all(dense, width, len(classes), settings)
    for name in (models.LONG_NAMES[0], models.LONG_NAMES[2]):
        a = one[name].transform(sparse).select("id", "prediction", "probability").orderBy("id").toPandas()
        b = two[name].transform(dense).select("id", "prediction", "probability").orderBy("id").toPandas()
        assert (a.prediction == b.prediction).all()
        assert np.allclose(np.vstack([np.array(p) for p in a.probability]), np.vstack([np.array(p) for p in b.probability]), atol=1e-5)
    forest = one[models.LONG_NAMES[1]].transform(sparse).toPandas()
    assert (forest.prediction == forest.label).mean() > 0.7


def test_a_hundred_thousand_categories(spark):
    """Boosting and logistic regression learn which of 100,000 categories are of which class."""
    n = 100_000
    df = spark.range(3 * n).select(
        F.col("id"), F.format_string("k%06d", F.col("id") % n).alias("k"), F.when(F.col("id") % n == 77, "rare").when(F.col("id") % 2 == 0, "a").otherwise("b").alias("y"),
        F.when(F.col("id") % n == 77, 3.0).otherwise(F.col("id") % 2).cast("double").alias("x"),
    )
    coded, sizes = encode.sparse_codes(*encode.one_hot_sparse(df, ["k"]))
    assert sizes == {"k_code": n}
    rows, classes = models.prepare(coded, "y", ["x"], "id", codes_of=sizes)
    settings = models.ModelSettings(names=("linear", "forest", "boosted"), balanced=False, rounds=2, logistic_iterations=5)
    build = models.estimators(settings, 1, 3, 3 * n, list(sizes.values()))
    for name in ("linear", "boosted"):
        out = build[name]().fit(rows).transform(rows)
        assert out.where("prediction = label").count() > 0.99 * 3 * n
    alone = boosting.fit_boosting(rows.withColumn("label", (F.col("label") == 2).cast("double")), ["c0"], 2, 3, 0.5, 1, 32, one_hot=[n])[0]
    assert alone.feature[0][0] == [0] and alone.cut[0][0] == [77.0]  # the one category that tells


def test_training_with_categories(spark):
    df = spark.createDataFrame(frame())
    settings = models.ModelSettings(rounds=30, trees=20, depth=10)
    run = training.train_and_evaluate(df, "y", "id", ["size"], categories=["city", "kind"], settings=settings)
    scores = {r.model: r.accuracy for r in run.scores.collect()}
    assert scores["GradientBoostingClassifier"] > 0.6 and all(v is not None for v in scores.values())
    only = training.train_and_evaluate(df.drop("size"), "y", "id", categories=["city"], settings=models.ModelSettings(rounds=2, trees=3, depth=3, logistic_iterations=10))
    assert only.scores.where("error is null").count() == 3
    with pytest.raises(ValueError):
        training.train_and_evaluate(df, "y", "id", ["size"], categories=["city"], oversample=True)
