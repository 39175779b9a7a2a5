"""The three classifiers, their data preparation and their scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import number, numeric_columns, quoted, with_target
from ..session import write_out
from .boosting import JointBoosting
from .encode import label_codes, label_encode, sparse_stages
from .evaluate import confusion, metrics, metrics_of
from .forest import DeepForest
from .impute import fit_median
from .lookup import pin
from .ordering import fit_tasks, spread
from .split import SEED, with_class_weight

# Names, iterations, trees and boosting settings of the compared models.
LONG_NAMES = ["Logistic Regression", "RandomForestClassifier", "GradientBoostingClassifier"]
SHORT_NAMES = ["Logistic Regression", "Random Forest", "Gradient Boosting"]
LOGISTIC_ITERATIONS = 500
FOREST_TREES = 50
BOOSTING_ROUNDS = 50
BOOSTING_RATE = 0.1
BOOSTING_DEPTH = 3
FOREST_DEPTH = 10  # Spark's forests stop at 30; None grows trees to pure leaves (see forest)

SCORE_SCHEMA = "model string, accuracy double, precision double, recall double, f1 double, error string"


@dataclass(frozen=True)
class ModelSettings:
    """Sizes of the three models and whether classes are weighted to balance. ``depth`` is the
    forest's; None sets no limit."""

    names: Sequence[str] = tuple(LONG_NAMES)
    balanced: bool = True
    logistic_iterations: int = LOGISTIC_ITERATIONS
    trees: int = FOREST_TREES
    rounds: int = BOOSTING_ROUNDS
    depth: int | None = FOREST_DEPTH
    max_bins: int = 32
    max_classes: int | None = None
    seed: int = SEED


def feature_names(df: DataFrame, target: str, features: Sequence[str] | None = None, id_col: str | None = None) -> list[str]:
    """Numeric columns but the target (and the row id, which is no measurement)."""
    numeric = numeric_columns(df if features is None else df.select(*[quoted(f) for f in features]))
    return [c for c in numeric if c not in (target, id_col)]


def prepare(
    df: DataFrame, target: str, features: Sequence[str], id_col: str, fill: bool = True, max_classes: int | None = None,
    codes_of: dict[str, int] | None = None,
) -> tuple[DataFrame, list]:
    """Rows with a target as (id, f0.., label), medians filled, and the class names by label.

    The code columns ``codes_of`` (with their numbers of codes) become c0.., where a missing
    code is the number of codes.
    """
    rows = with_target(df, target)
    if fill:
        rows = fit_median(rows, features).apply(rows)
    kind = dict(df.dtypes)[target]
    if kind in ("double", "float") and not rows.filter(quoted(target) != F.floor(quoted(target))).isEmpty():
        raise ValueError(f"{target} is continuous; bin it before classification")
    codes = label_codes(rows, target)
    if max_classes is not None and codes.count() > max_classes:
        raise ValueError(f"{target} has more than {max_classes} classes")
    classes = [r["value"] for r in codes.orderBy("code").collect()]
    coded = label_encode(rows, target, name="_label", codes=codes)
    out = coded.select(
        quoted(id_col).alias("id"),
        *[number(coded, c).alias(f"f{i}") for i, c in enumerate(features)],
        *[F.coalesce(quoted(c), F.lit(n)).cast("double").alias(f"c{i}") for i, (c, n) in enumerate((codes_of or {}).items())],
        F.col("_label").cast("double").alias("label"),
    )
    return out, classes


def write_prepared(rows: DataFrame) -> DataFrame:
    """The rows of ``prepare`` as a copy in parts that follow from their number: a small file of a
    long table is read by a task or two, and so would be every pass over a copy in its parts."""
    order = [c for c in rows.columns if c != "label"]
    return write_out(rows.repartition(fit_tasks(rows.count()), *order), "prepared")


def estimators(
    settings: ModelSettings, features: int, classes: int, rows: int, codes: Sequence[int] = ()
) -> dict[str, Callable[[], Estimator]]:
    """One pipeline per model over the columns f0.., c0.. (``codes`` of them each), label and weight."""
    inputs, coded = [f"f{i}" for i in range(features)], {f"c{i}": n for i, n in enumerate(codes)}
    weighted = {"weightCol": "weight"} if settings.balanced else {}

    def piped(classifier: Estimator) -> Estimator:
        return Pipeline(stages=[*sparse_stages(SparkSession.active(), inputs, coded, "features"), classifier])

    def logistic() -> Estimator:
        # The penalty of weight 1 against a summed loss, as Spark averages the loss.
        return piped(
            LogisticRegression(
                maxIter=settings.logistic_iterations, regParam=1.0 / max(rows, 1), standardization=False, **weighted
            )
        )

    def forest() -> Estimator:
        if settings.depth is None and coded:
            raise ValueError("forests without a depth limit take number columns only")
        if settings.depth is None:
            deep = DeepForest(inputCols=inputs, classes=max(classes, 2), numTrees=settings.trees, balanced=settings.balanced, seed=settings.seed)
            return Pipeline(stages=[deep])
        return piped(
            RandomForestClassifier(
                numTrees=settings.trees, seed=settings.seed, maxDepth=settings.depth, maxBins=settings.max_bins,
                featureSubsetStrategy="sqrt", cacheNodeIds=True, **weighted
            )
        )

    def boosting() -> Estimator:
        joint = JointBoosting(
            inputCols=[*inputs, *coded], classes=max(classes, 2), maxIter=settings.rounds, stepSize=BOOSTING_RATE, maxDepth=BOOSTING_DEPTH,
            maxBins=settings.max_bins, oneHot=[0] * features + list(codes),
        )
        return Pipeline(stages=[joint])

    return dict(zip(settings.names, (logistic, forest, boosting)))


def hold(df: DataFrame) -> DataFrame:
    """Keep the training rows for the passes of an iterative fit; lost blocks are recomputed."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def side_by_side(spark, jobs: Sequence[Callable], threads: int) -> list:
    """Run independent fits from several driver threads, so that their jobs overlap."""
    if not jobs:
        return []
    pool = ThreadPool(min(threads, len(jobs)))
    try:
        return pool.map(lambda job: job(), [inheritable_thread_target(spark)(job) for job in jobs])
    finally:
        pool.close()


def fit_all(
    train: DataFrame, features: int, classes: int, settings: ModelSettings, threads: int = 3, codes: Sequence[int] = ()
) -> dict[str, PipelineModel | Exception]:
    """Fit every model on the training rows; a model that fails gives its exception."""
    rows = train.count()
    # Synthetic rows have no id; their values tell them apart.
    train = spread(train, rows, ["id", *[f"f{i}" for i in range(features)], *[f"c{i}" for i in range(len(codes))]])
    if settings.balanced:
        train = with_class_weight(train, "label")
    train = hold(train)
    builders = estimators(settings, features, classes, rows, codes)

    def attempt(build: Callable[[], Estimator]) -> PipelineModel | Exception:
        try:
            return build().fit(train)
        except Exception as problem:  # reported in the result, one model must not end the run
            return problem

    try:
        fitted = side_by_side(train.sparkSession, [lambda b=b: attempt(b) for b in builders.values()], threads)
    finally:
        train.unpersist()
    return dict(zip(builders, fitted))


def predict(model: Model, df: DataFrame) -> DataFrame:
    return model.transform(df).select("label", "prediction")


def predict_classes(model: Model, rows: DataFrame, classes: list) -> DataFrame:
    """(id, predicted): the class of each prepared row, by name."""
    names = F.array(*[F.lit(c) for c in classes])
    return model.transform(rows).select("id", F.get(names, F.col("prediction").cast("int")).alias("predicted"))


def confusions(fitted: dict, test: DataFrame) -> dict[str, DataFrame]:
    """The confusion table of each fitted model, for all measures of it: the test rows are predicted once."""
    tables = {}
    for name, model in fitted.items():
        if not isinstance(model, Exception):
            table = confusion(predict(model, test), "label", "prediction")
            tables[name] = pin(table) or write_out(table, "confusion")
    return tables


def score_all(fitted: dict, test: DataFrame, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row per model: weighted metrics on the test rows, or the error that stopped it. ``tables``
    are the ``confusions``, if already known."""
    rows = []
    for name, model in fitted.items():
        if isinstance(model, Exception):
            rows.append((name, None, None, None, None, str(model)[:500]))
            continue
        m = (metrics(predict(model, test)) if tables is None else metrics_of(tables[name])).first()
        rows.append((name, m["accuracy"], m["precision"], m["recall"], m["f1"], None) if m else (name, *[None] * 4, "no test rows"))
    return test.sparkSession.createDataFrame(rows, SCORE_SCHEMA)
