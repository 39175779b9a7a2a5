"""Forests without a depth limit, against plain trees."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from riskloom.operators import forest


def plain_tree(x, y, weight):
    """(nested tree, impurity taken by column): every split of every column, to pure leaves."""
    gains = np.zeros(x.shape[1])

    def gini(rows):
        w = np.array([weight[c] * (y[rows] == c).sum() for c in range(len(weight))])
        return w.sum() - (w**2).sum() / w.sum() if w.sum() else 0.0

    def grow(rows):
        best = None
        if len(set(y[rows])) > 1:
            for f in range(x.shape[1]):
                values = np.unique(x[rows, f])
                for a, b in zip(values[:-1], values[1:]):
                    low = rows[x[rows, f] <= a]
                    gain = gini(rows) - gini(low) - gini(rows[x[rows, f] > a])
                    if best is None or round(gain, 9) > round(best[0], 9):
                        best = gain, f, (a + b) / 2
        if best is None:
            return np.array([weight[c] * (y[rows] == c).sum() for c in range(len(weight))])
        gains[best[1]] += best[0]
        low = x[rows, best[1]] <= best[2]
        return best[1], best[2], grow(rows[low]), grow(rows[~low])

    return grow(np.arange(len(x))), gains


def answer(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree / tree.sum()


def frame(n=300, seed=2):
    r = np.random.default_rng(seed)
    x = r.integers(0, 12, (n, 3)).astype(float)
    y = ((x[:, 0] > 5).astype(int) + (x[:, 1] * x[:, 2] > 40)) % 3
    y = np.where(r.random(n) < 0.15, r.integers(0, 3, n), y)
    return pd.DataFrame({"a": x[:, 0], "b.c": x[:, 1], "d": x[:, 2], "label": y.astype(float)})


COLUMNS = ["a", "b.c", "d"]


@pytest.mark.parametrize("node_rows", [10_000, 40, 7])  # in one task, or with upper levels
@pytest.mark.parametrize("weight", [[1.0, 1.0, 1.0], [2.0, 1.0, 0.5]])
def test_one_tree_against_a_plain_one(spark, node_rows, weight):
    pdf = frame()
    x, y = pdf[COLUMNS].to_numpy(), pdf.label.to_numpy().astype(int)
    tree, gains = plain_tree(x, y, weight)
    one = forest.ForestSettings(trees=1, features=3, bootstrap=False, node_rows=node_rows)
    df = spark.createDataFrame(pdf).repartition(3)
    made = forest.fit_forest(df, COLUMNS, 3, weight, one)
    assert np.allclose(made.importances, gains / gains.sum())
    for limit in (forest.SENT_BYTES, -1):
        out = forest.forest_probabilities(spark.createDataFrame(pdf), made, sent_bytes=limit).toPandas()
        assert np.allclose(np.vstack(out.probability), [answer(tree, r) for r in out[COLUMNS].to_numpy()])


@pytest.mark.parametrize("node_rows", [10_000, 10])
def test_a_table_that_needs_depth_40(spark, node_rows):
    """Classes in a pattern that peels off a few values at a time; the leaves are pure."""
    pdf = pd.DataFrame({"x": np.repeat(np.arange(120.0), 3), "label": np.repeat([float(k % 2) for k in range(120)], 3)})
    pdf["label"] = np.where(pdf.x % 2 == 0, 0.0, 1.0)
    one = forest.ForestSettings(trees=1, bootstrap=False, node_rows=node_rows)
    made = forest.fit_forest(spark.createDataFrame(pdf), ["x"], 2, None, one)
    out = forest.forest_probabilities(spark.createDataFrame(pdf), made).toPandas()
    assert (np.vstack(out.probability)[np.arange(len(out)), out.label.astype(int)] == 1).all()
    if node_rows == 10_000:
        body = np.frombuffer(made.parts.first()["body"]).reshape(-1, 6)

        def depth(k):
            return 0 if body[k, 0] < 0 else 1 + max(depth(int(body[k, 2])), depth(int(body[k, 3])))

        assert depth(0) >= 40


def test_forest_generalises_and_repeats(spark):
    pdf = frame(1500, 5)
    train, test = spark.createDataFrame(pdf[:1000]), spark.createDataFrame(pdf[1000:])
    settings = forest.ForestSettings(trees=15, node_rows=200)
    made = forest.fit_forest(train.coalesce(1), COLUMNS, 3, None, settings)
    out = forest.forest_probabilities(test, made).toPandas()
    p = np.vstack(out.probability)
    assert np.allclose(p.sum(axis=1), 1) and (p.argmax(axis=1) == out.label).mean() > 0.75
    again = forest.fit_forest(train.coalesce(1), COLUMNS, 3, None, settings)
    assert again.tops == made.tops and again.importances == made.importances
    assert sum(made.importances) == pytest.approx(1) and min(made.importances) > 0.05


def test_draws_are_a_sample_with_replacement():
    keys = np.arange(20_000)
    a, b = (forest.draws(keys, t, forest.ForestSettings()) for t in (0, 1))
    assert abs(a.mean() - 1) < 0.03 and abs((a == 0).mean() - np.exp(-1)) < 0.02
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.03
    assert (forest.draws(keys, 0, forest.ForestSettings(bootstrap=False)) == 1).all()


def test_heavy_values_get_bins_of_their_own(spark):
    """A value that most rows have can be told from its neighbour also in the upper levels."""
    x = np.concatenate([np.full(300, 5.0), np.full(5, 4.99), np.arange(60.0)])
    pdf = pd.DataFrame({"x": x, "label": (x == 4.99).astype(float)})
    one = forest.ForestSettings(trees=1, bootstrap=False, node_rows=20)
    made = forest.fit_forest(spark.createDataFrame(pdf), ["x"], 2, None, one)
    out = forest.forest_probabilities(spark.createDataFrame(pdf), made).toPandas()
    assert (np.vstack(out.probability).argmax(axis=1) == out.label).all()


def test_odd_tables(spark):
    same = spark.createDataFrame([(1.0, 0.0), (1.0, 1.0), (1.0, 1.0), (None, 0.0)], "x double, label double")
    made = forest.fit_forest(same, ["x"], 2, None, forest.ForestSettings(trees=2, bootstrap=False, node_rows=2))
    assert forest.forest_probabilities(same, made).first()["probability"] == pytest.approx([1 / 3, 2 / 3])
    empty = forest.fit_forest(same.limit(0), ["x"], 2, None, forest.ForestSettings(trees=2))
    assert forest.forest_probabilities(same, empty).first()["probability"] == [0.5, 0.5]
    assert forest.forest_probabilities(same.limit(0), made).collect() == []


def test_as_a_pipeline_stage(spark, tmp_path):
    df = spark.createDataFrame(frame())
    model = Pipeline(stages=[forest.DeepForest(inputCols=COLUMNS, classes=3, numTrees=5, balanced=True)]).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    order = ["a", F.col("`b.c`"), "d", "label"]
    a, b = (m.transform(df).orderBy(*order).toPandas() for m in (model, again))
    assert (a.prediction == b.prediction).all() and (a.prediction == a.label).mean() > 0.85
