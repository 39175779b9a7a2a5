"""Joint boosting and fold-wise fits, against plain versions of the same algorithms."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from riskloom.operators import boosting, linear, models, packed, split
from riskloom.sources import model_store


def frame(n=400, classes=3, seed=1):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(0, 1, (n, 3)), 1)
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 > 0.3).astype(int) + (classes > 2) * (x[:, 2] > 0.5)
    y = np.where(r.random(n) < 0.1, r.integers(0, classes, n), y)
    return pd.DataFrame({"id": np.arange(n), "f0": x[:, 0], "f1": x[:, 1], "f2": x[:, 2], "label": y.astype(float), "fold": (np.arange(n) % 3).astype(np.int32)})


COLUMNS = ["f0", "f1", "f2"]


def plain_boosting(x, y, classes, cuts, rounds, rate, depth):
    """Probabilities after every round, with trees grown row by row."""
    outputs = 1 if classes == 2 else classes
    prior = np.array([(y == k).mean() for k in range(classes)])
    f = np.tile(np.log(prior[1:] / prior[:1]) if outputs == 1 else np.log(prior), (len(y), 1))

    def probabilities(f):
        if outputs == 1:
            p = 1 / (1 + np.exp(-f))
            return np.hstack([1 - p, p])
        e = np.exp(f)
        return e / e.sum(axis=1, keepdims=True)

    def grow(rows, r, level):
        best = None
        if level < depth:
            for j in range(x.shape[1]):
                for c in cuts[j]:
                    a, b = rows[x[rows, j] <= c], rows[x[rows, j] > c]
                    if len(a) and len(b):
                        gain = r[a].sum() ** 2 / len(a) + r[b].sum() ** 2 / len(b) - r[rows].sum() ** 2 / len(rows)
                        if gain > 1e-12 * max(1, len(rows)) and (best is None or gain > best[0] + 1e-9):
                            best = gain, a, b
        if best:
            return grow(best[1], r, level + 1) + grow(best[2], r, level + 1)
        curve = (np.abs(r[rows]) * (1 - np.abs(r[rows]))).sum()
        return [(rows, r[rows].sum() / curve * (1 if classes == 2 else (classes - 1) / classes))]

    for _ in range(rounds):
        p = probabilities(f)
        step = np.zeros_like(f)
        for s in range(outputs):
            r = (y == (1 if outputs == 1 else s)) - p[:, -1 if outputs == 1 else s]
            for rows, value in grow(np.arange(len(y)), r, 0):
                step[rows, s] = rate * value
        f = f + step
    return probabilities(f)


@pytest.mark.parametrize("classes", [2, 3, 4])
def test_boosting_against_a_plain_version(spark, classes):
    pdf = frame(classes=min(classes, 3))
    if classes == 4:
        pdf.loc[pdf.id % 7 == 0, "label"] = 3.0
    df = spark.createDataFrame(pdf).repartition(3, "id")
    cuts = packed.thresholds(df, COLUMNS, 8)
    made = boosting.fit_boosting(df, COLUMNS, classes, 6, 0.3, 3, 8)[0]
    x = pdf[COLUMNS].to_numpy()
    got = made.probabilities(x)
    assert np.allclose(got.sum(axis=1), 1)
    assert np.allclose(got, plain_boosting(x, pdf.label.to_numpy(), classes, cuts, 6, 0.3, 3), atol=1e-9)


def test_boosting_of_all_folds_equals_fold_by_fold(spark, monkeypatch):
    monkeypatch.setattr(boosting, "CUT_ROUNDS", 2)  # scores written between rounds
    df = spark.createDataFrame(frame())
    cuts = packed.thresholds(df, COLUMNS, 16)
    x = frame()[COLUMNS].to_numpy()
    together = boosting.fit_boosting(df, COLUMNS, 3, 5, 0.1, 3, 16, folds=3, cuts=cuts)
    for k, made in enumerate(together):
        alone = boosting.fit_boosting(df.where(F.col("fold") != k), COLUMNS, 3, 5, 0.1, 3, 16, cuts=cuts)[0]
        assert np.allclose(alone.probabilities(x), made.probabilities(x), atol=1e-9)


@pytest.mark.parametrize("classes, folds", [(2, 0), (3, 0), (3, 3)])
def test_boosting_by_cells_equals_boosting_by_rows(spark, monkeypatch, classes, folds):
    """Two columns of four bins: cells are far fewer than rows, and give the same trees."""
    pdf = frame(n=900, classes=classes)
    pdf.loc[pdf.id % 50 == 0, "f0"] = None
    df = spark.createDataFrame(pdf).repartition(3, "id")
    cuts, passed, blocks = [np.array([-0.7, 0.0, 0.7]), np.array([-0.5, 0.1, 0.6])], [], boosting.blocks
    monkeypatch.setattr(boosting, "blocks", lambda df, *rest: passed.append(df.count()) or blocks(df, *rest))
    monkeypatch.setattr(boosting, "CUT_ROUNDS", 2)

    def fitted():
        return boosting.fit_boosting(df, COLUMNS[:2], classes, 5, 0.3, 3, 4, folds=folds, cuts=cuts)

    cells = fitted()
    monkeypatch.setattr(boosting, "CELL_ROWS", len(pdf) + 1)
    rows = fitted()
    assert passed[0] <= 16 * classes * max(1, folds) and passed[1] == len(pdf)
    for a, b in zip(cells, rows, strict=True):
        assert (a.feature, a.cut) == (b.feature, b.cut)
        x = pdf[COLUMNS[:2]].to_numpy()
        assert np.allclose(a.probabilities(x), b.probabilities(x), atol=1e-9)


def test_boosting_by_cells_of_codes(spark):
    """A column of codes with a missing one, and a number column, in few cells."""
    pdf = pd.DataFrame({"f0": np.arange(600) % 3 * 1.0, "c0": [float(k) if k < 2 else None for k in np.arange(600) % 5], "label": (np.arange(600) % 5 == 1) * 1.0})
    made = boosting.fit_boosting(spark.createDataFrame(pdf), ["f0", "c0"], 2, 20, 0.5, 2, 4, one_hot=[0, 2])[0]
    assert (made.predict(pdf[["f0", "c0"]].to_numpy()) == pdf.label).all()


def test_sums_are_the_same_through_executors(spark, monkeypatch):
    df = spark.createDataFrame(frame()).repartition(4, "id")
    direct = boosting.fit_boosting(df, COLUMNS, 3, 3, 0.1, 3, 16)[0]
    monkeypatch.setattr(packed, "DIRECT_BYTES", 0)
    assert boosting.fit_boosting(df, COLUMNS, 3, 3, 0.1, 3, 16)[0] == direct


def test_boosting_as_a_pipeline_stage(spark, tmp_path):
    pdf = frame()
    df = spark.createDataFrame(pdf)
    settings = models.ModelSettings(rounds=5)
    model = models.estimators(settings, 3, 3, len(pdf))[models.LONG_NAMES[2]]().fit(df)
    out = model.transform(df).toPandas()
    assert (out.prediction == out.label).mean() > 0.8
    assert np.allclose(np.vstack(out.probability).sum(axis=1), 1)
    again = model_store.load_model(model_store.save_model(model, str(tmp_path))).transform(df).toPandas()
    assert (again.prediction == out.prediction).all()
    gaps = spark.createDataFrame([(None, 1.0, float("nan"))], "f0 double, f1 double, f2 double")
    assert model.transform(gaps).first()["prediction"] in (0.0, 1.0, 2.0)


@pytest.mark.parametrize("classes", [2, 3])
def test_logistic_folds_equal_the_ml_library(spark, classes):
    pdf = frame(classes=classes).assign(f1=lambda d: 1000 * d.f1 + 5)  # columns of different scales
    df = spark.createDataFrame(pdf)
    sizes = packed.held_out(packed.fold_sizes(df, classes), 3)
    together = linear.fit_logistic(df, COLUMNS, classes, sizes, True, 500, 3)
    x = pdf[COLUMNS].to_numpy()
    for k, made in enumerate(together):
        train = split.with_class_weight(df.where(F.col("fold") != k), "label")
        train = VectorAssembler(inputCols=COLUMNS, outputCol="features").transform(train)
        reg = 1 / train.count()
        ml = LogisticRegression(maxIter=500, tol=1e-12, regParam=reg, standardization=False, weightCol="weight").fit(train)
        whole = VectorAssembler(inputCols=COLUMNS, outputCol="features").transform(df)
        want = np.vstack([r.probability.toArray() for r in ml.transform(whole).orderBy("id").collect()])
        assert np.allclose(made.probabilities(x), want, atol=1e-3)


def test_fold_without_a_class(spark):
    """A class that only one fold has is missing from that fold's fit."""
    pdf = frame().assign(label=lambda d: np.where((d.label == 2) & (d.fold != 0), 1.0, d.label))
    df = spark.createDataFrame(pdf)
    sizes = packed.held_out(packed.fold_sizes(df, 3), 3)
    assert sizes[0][2] == 0
    assert linear.fit_logistic(df, COLUMNS, 3, sizes, True, 50, 3)[0].probabilities(pdf[COLUMNS].to_numpy()).shape == (400, 3)
    boosted = boosting.fit_boosting(df, COLUMNS, 3, 3, 0.1, 3, 16, folds=3)[0]
    assert (boosted.predict(pdf[COLUMNS].to_numpy()) != 2).all()
