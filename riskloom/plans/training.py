"""Training runs: evaluate, compare targets, cross-validate, pick the best, oversample."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import TARGETS, numeric_columns, present, quoted, string_columns
from ..operators.encode import label_codes_of, label_encode, one_hot_sparse, sparse_codes
from ..operators.boosting import fit_boosting, scored
from ..operators.evaluate import metrics, report_of
from ..operators.impute import fit_mean, fit_median
from ..operators.linear import fit_logistic
from ..operators.models import (
    BOOSTING_DEPTH, BOOSTING_RATE, SHORT_NAMES, ModelSettings, confusions, estimators, feature_names, fit_all, hold, predict, prepare,
    score_all, side_by_side, write_prepared,
)
from ..operators.lookup import attach_local, pin
from ..operators.ordering import spread
from ..operators.packed import fold_sizes, held_out
from ..operators.smote import smote
from ..operators.split import FOLDS, TEST_SHARE, assign_folds, parts, random_split, stratified_split
from ..session import scratch, write_out

DETAILED = ModelSettings()
CROSS_VALIDATED = ModelSettings(names=tuple(SHORT_NAMES))
# Sizes of the end-to-end trainer.
PLAIN = ModelSettings(names=tuple(SHORT_NAMES), balanced=False, logistic_iterations=1000, trees=100, rounds=100)
DEFAULT_FEATURES = 5


@dataclass(frozen=True)
class Evaluation:
    """Scores per model, the fitted models, and the shapes of both parts."""

    scores: DataFrame
    models: dict[str, PipelineModel | Exception]
    info: dict


def train_and_evaluate(
    df: DataFrame,
    target: str,
    id_col: str,
    features: Sequence[str] | None = None,
    test_share: float = TEST_SHARE,
    fit_on: str = "all",
    oversample: bool = False,
    settings: ModelSettings = DETAILED,
    categories: Sequence[str] = (),
) -> Evaluation:
    """Fill medians, split at random, optionally oversample the training part, fit and score.

    Medians come from the whole table by default; ``fit_on="train"`` takes them from the
    training part alone, so that nothing of the test rows reaches the models. If the training
    part can't be oversampled, it is used as it is and ``info["oversampling"]`` says why.
    Text columns in ``categories`` are one-hot encoded, whatever the number of their values.
    """
    names = feature_names(df, target, features, id_col)
    if not names and not categories:
        raise ValueError("select at least one numeric feature")
    if categories and oversample:
        raise ValueError("points between categories can't be made: oversampling takes numbers only")
    with scratch(df.sparkSession):
        return _evaluated(df, target, id_col, names, test_share, fit_on, oversample, settings, list(categories))


def _evaluated(df, target, id_col, names, test_share, fit_on, oversample, settings, categories) -> Evaluation:
    codes_of: dict[str, int] = {}
    if categories:
        df, codes_of = sparse_codes(*one_hot_sparse(df, categories))
    rows, classes = prepare(df, target, names, id_col, fit_on == "all", settings.max_classes, codes_of)
    columns = [f"f{i}" for i in range(len(names))]
    train, test = parts(random_split(write_prepared(rows), "id", test_share))
    if fit_on == "train":
        fill = fit_median(train, columns)
        train, test = fill.apply(train), fill.apply(test)
    shapes = {"train_rows": train.count(), "test_rows": test.count(), "features": len(names)}
    if oversample:
        try:
            train = write_out(smote(train, columns, "label", "id"), "smote")
        except Exception as problem:  # reported, the run goes on
            shapes["oversampling"] = str(problem)[:500]
    fitted = fit_all(train, len(names), len(classes), settings, codes=list(codes_of.values()))
    info = {"target": target, "classes": classes, **shapes}
    return Evaluation(score_all(fitted, test), fitted, info)


def long_scores(scores: DataFrame, measures: Sequence[str] = ("accuracy", "precision", "recall", "f1")) -> DataFrame:
    """(model, measure, value): the shape a grouped bar chart takes."""
    return scores.unpivot(["model"], list(measures), "measure", "value")


def compare_targets(
    df: DataFrame, id_col: str, targets: Sequence[str] = TARGETS, settings: ModelSettings = DETAILED, **options
) -> DataFrame:
    """(target, model, accuracy, f1) for each target the table has."""
    found = present(df, targets)
    if not found:
        raise ValueError(f"none of {list(targets)} is a column")
    tables = [
        train_and_evaluate(df, t, id_col, settings=settings, **options)
        .scores.select(F.lit(t).alias("target"), "model", "accuracy", "f1")
        for t in found
    ]
    return reduce(DataFrame.unionByName, tables)


def cross_validate(
    df: DataFrame,
    target: str,
    id_col: str,
    folds: int = FOLDS,
    features: Sequence[str] | None = None,
    settings: ModelSettings = CROSS_VALIDATED,
    threads: int = 5,
) -> DataFrame:
    """Mean and standard deviation (over folds) of accuracy and weighted F1 per model.

    Both measures come from one confusion table. All folds of the logistic regression are
    fitted in the same passes over the rows, and so are those of the boosting, on one
    binning; forests are fitted fold by fold, side by side.
    """
    with scratch(df.sparkSession):
        return _cross_validated(df, target, id_col, folds, feature_names(df, target, features, id_col), settings, threads)


def _cross_validated(df, target, id_col, folds, names, settings, threads) -> DataFrame:
    rows, classes = prepare(df, target, names, id_col, max_classes=settings.max_classes)
    rows = write_prepared(rows)
    dealt = hold(spread(assign_folds(rows, "id", "label", folds), rows.count(), ["id"]))
    spark, columns, count = df.sparkSession, [f"f{i}" for i in range(len(names))], max(len(classes), 2)
    sizes = held_out(fold_sizes(dealt, count), folds)
    linear, forest, boosted = settings.names

    def fold_metrics(predicted: DataFrame, name: str) -> list[tuple]:
        return [(name, m["fold"], m["accuracy"], m["f1"], None) for m in metrics(predicted, by=["fold"]).collect()]

    def all_linear() -> list[tuple]:
        fits = fit_logistic(dealt, columns, count, sizes, settings.balanced, settings.logistic_iterations, folds)
        return fold_metrics(scored(dealt, columns, fits, "fold"), linear)

    def all_boosted() -> list[tuple]:
        fits = fit_boosting(dealt, columns, count, settings.rounds, BOOSTING_RATE, BOOSTING_DEPTH, settings.max_bins, folds)
        return fold_metrics(scored(dealt, columns, fits, "fold"), boosted)

    def one_forest(i: int) -> list[tuple]:
        train = dealt.filter(F.col("fold") != i)
        if settings.balanced:
            held = {k: n for k, n in enumerate(sizes[i]) if n}
            weights = [(float(k), float(sum(held.values()) / (len(held) * n))) for k, n in held.items()]
            train = attach_local(train, spark.createDataFrame(weights, "label double, weight double"), ["label"])
        build = estimators(settings, len(names), len(classes), int(sizes[i].sum()))[forest]
        return fold_metrics(predict(build().fit(train), dealt.filter(F.col("fold") == i)).withColumn("fold", F.lit(i)), forest)

    def attempt(job, name: str) -> list[tuple]:
        try:
            return job()
        except Exception as problem:  # reported in the result
            return [(name, -1, None, None, str(problem)[:500])]

    # The fits that share their passes come first: they have the most of them, one after another.
    jobs = [(all_boosted, boosted), (all_linear, linear), *[(lambda i=i: one_forest(i), forest) for i in range(folds)]]
    done = side_by_side(spark, [lambda j=j, n=n: attempt(j, n) for j, n in jobs], threads)
    dealt.unpersist()
    table = spark.createDataFrame([r for rows in done for r in rows], "model string, fold int, accuracy double, f1 double, error string")
    # A model that failed in any fold has no score.
    whole = F.count("accuracy") == folds

    def summary(f, measure: str) -> F.Column:
        return F.when(whole, F.round(f(measure), 4))

    return table.groupBy("model").agg(
        summary(F.avg, "accuracy").alias("mean_accuracy"), summary(F.stddev_pop, "accuracy").alias("std_accuracy"),
        summary(F.avg, "f1").alias("mean_f1"), summary(F.stddev_pop, "f1").alias("std_f1"), F.max("error").alias("error"),
    )


def best_model(scores: DataFrame, measure: str = "mean_f1", order: Sequence[str] = SHORT_NAMES) -> DataFrame:
    """The row of the best model; the first named wins a tie, a missing score never does."""
    place = F.array_position(F.array(*[F.lit(n) for n in order]), F.col("model"))
    return scores.filter(F.col(measure).isNotNull()).orderBy(F.desc(measure), place).limit(1)


def clean_data(df: DataFrame, target: str, id_col: str | None = None) -> DataFrame:
    """Label-encode text columns (a null becomes the category nan), fill means, keep names.

    Columns without any value are dropped. ``id_col`` is carried along untouched.
    """
    text = [c for c in string_columns(df) if c != id_col]
    for c, codes in label_codes_of(df, text, "nan").items():
        df = label_encode(df, c, missing="nan", codes=codes)
    others = [c for c in numeric_columns(df) if c not in (target, id_col, *text)]
    fill = fit_mean(df, others)
    empty = [c for c, p in fill.params.items() if p["fill"] is None]
    return fill.apply(df).drop(*empty)


@dataclass(frozen=True)
class Training:
    """Accuracy and report per model, and the winner."""

    scores: DataFrame
    reports: DataFrame
    best_name: str
    best_model: PipelineModel | None


def train_models(
    df: DataFrame, target: str, id_col: str, settings: ModelSettings = PLAIN, test_share: float = TEST_SHARE
) -> Training:
    """The end-to-end trainer: clean, split by class, fit three models, report, pick the most accurate."""
    with scratch(df.sparkSession):
        return _trained(df, target, id_col, settings, test_share)


def _trained(df, target, id_col, settings, test_share) -> Training:
    clean = clean_data(df, target, id_col)
    if clean.select(quoted(target)).dropna().distinct().limit(2).count() < 2:
        raise ValueError("the target needs at least two classes")
    features = [c for c in clean.columns if c not in (target, id_col)]
    rows, classes = prepare(clean, target, features, id_col, False, settings.max_classes)
    train, test = parts(stratified_split(write_prepared(rows), "id", "label", test_share))
    fitted = fit_all(train, len(features), len(classes), settings)
    tables = confusions(fitted, test)
    scores = score_all(fitted, test, tables)
    good = {name: model for name, model in fitted.items() if not isinstance(model, Exception)}
    reports = [report_of(table).withColumn("model", F.lit(name)) for name, table in tables.items()]
    reports = reduce(DataFrame.unionByName, reports) if reports else None
    if reports is not None:
        reports = pin(reports) or write_out(reports, "reports", keep=True)
    best = best_model(scores.filter("accuracy > 0"), "accuracy", list(settings.names)).first()
    return Training(
        scores.select("model", "accuracy", "error"),
        reports,
        best["model"] if best else "",
        good[best["model"]] if best else None,
    )


def train_interactive(
    df: DataFrame,
    target: str,
    id_col: str,
    features: Sequence[str] | None = None,
    test_share: float = TEST_SHARE,
    use_smote: bool = True,
    settings: ModelSettings = DETAILED,
) -> DataFrame:
    """(model, accuracy, f1) on chosen features; without a choice the first five numeric columns."""
    if features is None:
        features = [c for c in numeric_columns(df) if c not in (target, id_col)][:DEFAULT_FEATURES]
    if not features:
        raise ValueError("select at least one feature")
    run = train_and_evaluate(df, target, id_col, features, test_share, oversample=use_smote, settings=settings)
    return run.scores.select("model", "accuracy", "f1", "error")

