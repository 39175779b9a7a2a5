import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from riskloom.operators import evaluate, metric, models, smote, split
from riskloom.plans import training
from riskloom.sources import model_store
from riskloom.streaming import apply_steps
from riskloom.operators.transform import fit_standard_scale

few = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
LIGHT = models.ModelSettings(trees=5, rounds=3, depth=4, logistic_iterations=50)
LIGHT_CV = models.ModelSettings(names=tuple(models.SHORT_NAMES), trees=5, rounds=2, depth=4, logistic_iterations=50)


@pytest.fixture(scope="module")
def labelled(spark, tables):
    rule = "CASE WHEN p_size <= 15 THEN 0 WHEN p_retailprice < 905 THEN 1 ELSE 2 END"
    return tables("part").select("p_partkey", "p_size", "p_retailprice", F.concat(F.lit("t"), F.expr(rule).cast("string")).alias("y"))


@few
@given(st.integers(10, 200), st.floats(0.1, 0.5))
def test_random_split_size(spark, n, share):
    share = round(share, 2)
    got = split.random_split(spark.range(n), "id", share).agg(F.sum("is_test")).first()[0]
    assert got == int(np.ceil(round(n * share, 9)))


def test_stratified_split(spark):
    df = spark.range(997).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, None).otherwise("b").alias("y"))
    out = split.stratified_split(df, "id", "y").toPandas()
    assert out.is_test.sum() == 200 and len(out) == 997
    share = out.groupby("y", dropna=False).is_test.mean()
    assert ((share - 0.2).abs() < 0.06).all()
    lone = df.withColumn("y", F.when(F.col("id") == 0, "one").otherwise("rest"))
    assert split.stratified_split(lone, "id", "y").agg(F.sum("is_test")).first()[0] == 200


@few
@given(st.integers(3, 10), st.integers(30, 150))
def test_folds(spark, folds, n):
    df = spark.range(n).select("id", (F.col("id") % 3).alias("y"))
    out = split.assign_folds(df, "id", "y", folds).toPandas()
    assert len(out) == n and set(out.fold) == set(range(folds))
    sizes = out.fold.value_counts()
    assert sizes.max() - sizes.min() <= 1
    by_class = out.groupby(["y", "fold"]).size().unstack(fill_value=0)
    assert ((by_class.max(axis=1) - by_class.min(axis=1)) <= 1).all()


def test_split_cuts_on_large_groups(spark, monkeypatch):
    """The bracketed cuts give the same split as ranking whole groups."""
    df = spark.range(5_000).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"))
    whole = split.assign_folds(df, "id", "y").toPandas().sort_values("id").fold
    monkeypatch.setattr("riskloom.operators.quantiles.WINDOW_ROWS", 300)
    cut = split.assign_folds(df, "id", "y").toPandas().sort_values("id").fold
    assert (whole.to_numpy() == cut.to_numpy()).all()


def test_weights(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "y string")
    assert {r["y"]: r["weight"] for r in split.class_weights(df, "y").collect()} == {"a": 4 / 6, "b": 2.0}


@few
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=40))
def test_metrics(spark, pairs):
    df = spark.createDataFrame(pairs, "label int, prediction int")
    m = evaluate.metrics(df).first()
    accuracy = np.mean([a == b for a, b in pairs])
    assert np.isclose(m["accuracy"], accuracy) and np.isclose(m["recall"], accuracy)
    f1 = 0.0
    for c in {a for a, _ in pairs}:
        hit = sum(a == b == c for a, b in pairs)
        f1 += sum(a == c for a, _ in pairs) * 2 * hit / (sum(a == c for a, _ in pairs) + sum(b == c for _, b in pairs))
    assert np.isclose(m["f1"], f1 / len(pairs))


def test_metrics_agree_with_ml(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    df = spark.range(300).select((F.col("id") % 3).cast("double").alias("label"), (F.col("id") % 7 % 3).cast("double").alias("prediction"))
    m = evaluate.metrics(df).first()
    for mine, theirs in (("accuracy", "accuracy"), ("precision", "weightedPrecision"), ("recall", "weightedRecall"), ("f1", "f1")):
        assert np.isclose(m[mine], MulticlassClassificationEvaluator(metricName=theirs).evaluate(df))


def test_evaluate_beats_the_majority(labelled):
    run = training.train_and_evaluate(labelled, "y", "p_partkey", settings=LIGHT)
    scores = run.scores.toPandas()
    majority = labelled.groupBy("y").count().agg(F.max("count")).first()[0] / labelled.count()
    assert scores.error.isna().all() and (scores.accuracy > majority).all()
    assert run.info["train_rows"] == 160 and run.info["test_rows"] == 40 and run.info["classes"] == ["t0", "t1", "t2"]
    again = training.train_and_evaluate(labelled, "y", "p_partkey", settings=LIGHT).scores.toPandas()
    assert (again.accuracy == scores.accuracy).all()
    assert training.long_scores(run.scores).count() == 12
    train_fit = training.train_and_evaluate(labelled, "y", "p_partkey", settings=LIGHT, fit_on="train", oversample=True)
    assert train_fit.scores.filter("error is not null").count() == 0


def test_cross_validation_and_best(labelled):
    scores = training.cross_validate(labelled, "y", "p_partkey", folds=3, settings=LIGHT_CV)
    rows = {r["model"]: r for r in scores.collect()}
    assert set(rows) == set(models.SHORT_NAMES) and all(r["mean_f1"] > 0.4 for r in rows.values())
    best = training.best_model(scores).first()
    assert best["mean_f1"] == max(r["mean_f1"] for r in rows.values())


def test_best_model_ties(spark):
    rows = [("Gradient Boosting", 0.9), ("Random Forest", 0.9), ("Logistic Regression", None)]
    assert training.best_model(spark.createDataFrame(rows, "model string, mean_f1 double")).first()["model"] == "Random Forest"


def test_end_to_end_and_saved_model(spark, labelled, tmp_path):
    light = models.ModelSettings(names=tuple(models.SHORT_NAMES), balanced=False, trees=5, rounds=3, depth=4)
    mixed = labelled.withColumn("p_size", F.when(F.col("p_partkey") % 9 > 0, F.col("p_size"))).withColumn("site", F.lit("x"))
    run = training.train_models(mixed, "y", "p_partkey", settings=light)
    assert run.best_name in models.SHORT_NAMES and run.scores.count() == 3
    assert {r["class"] for r in run.reports.collect()} >= {"accuracy", "macro avg", "weighted avg"}
    rows, _ = models.prepare(training.clean_data(mixed, "y", "p_partkey"), "y", ["p_size", "p_retailprice", "site"], "p_partkey", fill=False)
    path = model_store.save_model(run.best_model, str(tmp_path))
    loaded = model_store.load_model(path)
    order = [f"f{i}" for i in range(run.best_model.stages[0].getInputCols().__len__())]
    assert order == loaded.stages[0].getInputCols()
    same = models.predict(run.best_model, rows).collect()
    assert models.predict(loaded, rows).collect() == same


def test_trainer_predicts_the_test_rows_once_a_model(labelled, monkeypatch):
    light, predict, asked = models.ModelSettings(names=tuple(models.SHORT_NAMES), balanced=False, trees=3, rounds=2, depth=3), models.predict, []
    for place in (models, training):
        monkeypatch.setattr(place, "predict", lambda model, df: asked.append(model) or predict(model, df))
    run = training.train_models(labelled, "y", "p_partkey", settings=light)
    shares = {r["model"]: r["f1"] for r in run.reports.filter("class = 'accuracy'").collect()}
    assert shares == {r["model"]: r["accuracy"] for r in run.scores.collect()}
    assert len(asked) == 3


def test_prepared_copy_follows_from_the_rows(spark):
    """One part of a table becomes as many as its rows ask for, with nothing lost."""
    rows = spark.range(0, 60_000, 1, 1).select(F.when(F.col("id") % 9 > 0, F.col("id")).alias("id"), F.col("id").cast("double").alias("f0"), F.lit(0.0).alias("label"))
    copy = models.write_prepared(rows)
    assert len(copy.inputFiles()) == 3 and copy.exceptAll(rows).count() == 0 and copy.count() == 60_000


def test_guards(spark, labelled):
    with pytest.raises(ValueError):
        training.train_models(labelled.withColumn("y", F.lit("one")), "y", "p_partkey")
    with pytest.raises(ValueError):
        training.train_and_evaluate(labelled, "p_retailprice", "p_partkey")
    with pytest.raises(ValueError):
        training.train_interactive(labelled.select("p_partkey", "y"), "y", "p_partkey")
    with pytest.raises(ValueError):
        training.compare_targets(labelled, "p_partkey")


def test_a_failing_model_is_reported(labelled):
    broken = models.ModelSettings(trees=5, rounds=2, depth=99)
    scores = training.train_and_evaluate(labelled, "y", "p_partkey", settings=broken).scores.toPandas().set_index("model")
    assert scores.error["RandomForestClassifier"] and scores.accuracy["Logistic Regression"] > 0


@pytest.fixture(scope="module")
def cloud(spark):
    r = np.random.default_rng(11)
    n = 1_200
    pdf = pd.DataFrame(r.normal(0, 1, (n, 4)), columns=["a", "b", "c", "d"])
    pdf.loc[:300, ["a", "b", "c", "d"]] = 0.5  # a quarter of the rows are copies of one point
    pdf["id"] = np.arange(n)
    pdf["y"] = np.where(pdf.id % 4 == 3, "big", "small")
    return pdf


def test_neighbours_across_cells(spark, cloud):
    """Cells of 30 points: distances of the nearest neighbours equal brute force."""
    part = cloud[cloud.y == "small"]
    points = spark.createDataFrame(part).select(
        F.col("y").alias("_c"), F.col("id").alias("_id"), F.array("a", "b", "c", "d").alias("_v")
    )
    near = smote.nearest_in_class(points, 4, 5, cell_rows=30).toPandas()
    assert len(near) == len(part)
    values, ids = part[["a", "b", "c", "d"]].to_numpy(), part.id.to_numpy()
    place = {i: j for j, i in enumerate(ids)}
    d = ((values[:, None] - values[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    for row in near.itertuples():
        want = np.sort(d[place[row._2]])[:5]
        assert np.allclose([n["d"] for n in row.near], want)
        assert row._2 not in [n["id"] for n in row.near]


def brute_neighbours(rows, k):
    """id: (squared distance, id) of its k nearest of the same class, by id where equally far."""
    out = {}
    for c, i, v in rows:
        d = [(float(((np.array(v) - np.array(w)) ** 2).sum()), j) for b, j, w in rows if b == c and j != i]
        out[i] = sorted(d)[:k]
    return out


@pytest.mark.parametrize("cell_rows", [3, 8, 1000])
def test_neighbours_with_ties_and_copies(spark, cell_rows):
    """Few values, so that most distances tie, also across cells; classes smaller than k."""
    r = np.random.default_rng(3)
    rows = [("a", i, [float(x) for x in r.integers(0, 3, 2)]) for i in range(60)]
    rows += [("b", 100 + i, [float(i % 7), 0.0]) for i in range(40)] + [("c", 200, [1.0, 1.0]), ("c", 201, [1.0, 1.0])]
    rows += [("d", 300 + i, [0.5, 0.5]) for i in range(50)]
    points = spark.createDataFrame(rows, "_c string, _id bigint, _v array<double>")
    near = {r["_id"]: [(n["d"], n["id"]) for n in r["near"]] for r in smote.nearest_in_class(points, 2, 5, cell_rows).collect()}
    assert near == brute_neighbours(rows, 5)


def test_neighbours_in_many_features(spark):
    """20 features: exact, and far fewer comparisons than of all rows with all."""
    r = np.random.default_rng(4)
    centres = r.normal(0, 10, (25, 20))
    v = centres[r.integers(0, 25, 3000)] + r.normal(0, 1, (3000, 20)) * np.array([1.0] * 4 + [0.05] * 16)
    rows = [("x", i, [float(x) for x in p]) for i, p in enumerate(v)]
    points = spark.createDataFrame(rows, "_c string, _id bigint, _v array<double>")
    lists = metric.nearest_lists(points, 20, 5, 40).toPandas()
    compared = lists.compared.sum()
    assert len(lists) == 3000 and compared < 0.1 * 3000 * 3000
    d = ((v[:300, None] - v[None]) ** 2).sum(axis=2)
    want = {tuple(p): np.sort(row)[:6] for p, row in zip(v[:300], d)}
    found = {tuple(x): [n["d"] for n in near] for x, near in zip(lists._v, lists.near)}
    assert all(np.allclose(found[p], w) for p, w in want.items())


def test_small_cells_compare_few_points(spark):
    """Cells of 8 points: a point is compared with those beside it, however many cells there are."""
    r = np.random.default_rng(5)
    rows = [("x", i, [float(x) for x in p]) for i, p in enumerate(r.uniform(0, 1, (3000, 2)))]
    points = spark.createDataFrame(rows, "_c string, _id bigint, _v array<double>")
    lists = metric.nearest_lists(points, 2, 5, 8).toPandas()
    assert len(lists) == 3000 and lists.compared.mean() < 300
    v = np.array([p for _, _, p in rows])
    place = {tuple(p): i for i, p in enumerate(v)}
    for x, near in zip(lists._v[:300], lists.near[:300]):
        assert np.allclose([n["d"] for n in near], np.sort(((v - v[place[tuple(x)]]) ** 2).sum(axis=1))[:6])


def test_neighbours_across_blocks(spark, monkeypatch):
    """Blocks of 16 points with ties and copies, and points with a missing value, which are near to nothing."""
    monkeypatch.setattr(metric, "BLOCK_ROWS", 16)
    r = np.random.default_rng(6)
    rows = [("a", i, [float(x) for x in r.integers(0, 12, 2)]) for i in range(200)]
    rows += [("b", 300 + i, [float(x) for x in r.normal(0, 1, 2)]) for i in range(100)]
    odd = [("a", 500, [None, 1.0]), ("b", 501, [0.5, None])]
    points = spark.createDataFrame(rows + odd, "_c string, _id bigint, _v array<double>")
    near = {r["_id"]: [(n["d"], n["id"]) for n in r["near"]] for r in smote.nearest_in_class(points, 2, 5, 4).collect()}
    assert near == brute_neighbours(rows, 5) | {500: [], 501: []}


@pytest.mark.parametrize("pinned", [True, False])
@pytest.mark.parametrize("id_kind", ["long", "string"])
def test_smote_balances(spark, cloud, monkeypatch, pinned, id_kind):
    if not pinned:
        monkeypatch.setattr("riskloom.operators.lookup.PIN_ROWS", 10)
    pdf = cloud.assign(y=np.where(cloud.id % 10 == 9, "rare", np.where(cloud.id % 3 == 0, "mid", "most")))
    df = spark.createDataFrame(pdf).withColumn("id", F.col("id").cast(id_kind))
    out = smote.smote(df, ["a", "b"], "y", "id", cell_rows=100).toPandas()
    assert out.y.value_counts().nunique() == 1
    made = out[out.id.isna()]
    for y, part in made.groupby("y"):
        own = pdf[pdf.y == y][["a", "b"]]
        assert (part[["a", "b"]] >= own.min() - 1e-9).all().all() and (part[["a", "b"]] <= own.max() + 1e-9).all().all()


def test_synthetic_points_lie_on_segments(spark):
    corners = [(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.0, 2.0)]
    rows = [(i, x, y, "rare") for i, x, y in corners] + [(i, 9.0, float(i), "most") for i in range(3, 60)]
    out = smote.smote(spark.createDataFrame(rows, "id long, x double, y double, k string"), ["x", "y"], "k", "id")
    for r in out.filter("id is null").collect():
        assert r["x"] == pytest.approx(0) or r["y"] == pytest.approx(0) or 2 * r["x"] + r["y"] == pytest.approx(2)
    lone = spark.createDataFrame([(0, 1.0, "a"), (1, 2.0, "b"), (2, 3.0, "b")], "id long, x double, k string")
    assert smote.smote(lone, ["x"], "k", "id").count() == 3


def test_fitted_step_on_a_stream(spark, tables, tmp_path):
    parts = tables("part").select("p_partkey", "p_retailprice")
    step = fit_standard_scale(parts, ["p_retailprice"])
    parts.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(parts.schema).parquet(str(tmp_path / "in"))
    q = apply_steps(stream, [step]).writeStream.format("memory").queryName("scaled").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["p_partkey"]: r["p_retailprice"] for r in spark.table("scaled").collect()}
    assert got == {r["p_partkey"]: r["p_retailprice"] for r in step.apply(parts).collect()}
    assert step.table(parts).count() == 2
