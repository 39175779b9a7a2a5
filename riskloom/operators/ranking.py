"""Feature scores against a class target: chi-squared, mutual information, forest importance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import numbers, quoted
from ..functions.scalars import chi2_upper_tail, digamma, unit
from .encode import label_encode
from .forest import ForestSettings, fit_forest
from .lookup import attach
from .ordering import WINDOW_ROWS, fit_tasks, rank_rows, running_total, spread
from .profile import long_form
from .quantiles import quantile_values
from .transform import column_stats

# Neighbours of the estimator, trees, features shown and kept, seed.
NEIGHBOURS = 3
TREES = 100
SHOWN_FEATURES = 20
KEPT_FEATURES = 10
SEED = 42
FOREST_ROWS = 2_500  # rows worth a task: a level of a hundred trees is much work
JITTER = 3e-10  # in standard deviations: breaks ties between equal values


def chi2_scores(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, chi2_score, p_value) of each feature's mass per class.

    Per class the observed mass is the sum of x - min(x) + 1 and the expected mass the
    class's share of the total. Minima come first, so that only differences are added up:
    values far from 0 lose no digits.
    """
    rows = numbers(df, features, keep=[target]).filter(quoted(target).isNotNull())
    low = rows.agg(*[F.min(quoted(c)).alias(f"_m{i}") for i, c in enumerate(features)]).first()
    by_class = rows.groupBy(quoted(target)).agg(
        F.count("*").alias("_n"),
        *[F.sum(quoted(c) - F.lit(low[f"_m{i}"]).cast("double") + 1).alias(f"_s{i}") for i, c in enumerate(features)],
    )
    long = long_form(by_class, features, lambda i, c: [F.col(f"_s{i}").alias("_observed")], keep=["_n"])
    every = Window.partitionBy("column_name")  # one row per class
    n = F.col("_n")
    seen = long.withColumn("_rows", F.sum("_n").over(every)).withColumn(
        "_expected", F.sum("_observed").over(every) * n / F.col("_rows")
    )
    return (
        seen.groupBy(F.col("column_name").alias("feature"))
        .agg(
            F.sum(F.try_divide((F.col("_observed") - F.col("_expected")) ** 2, F.col("_expected"))).alias("chi2_score"),
            (F.count("*") - 1).cast("int").alias("_dof"),
        )
        .select("feature", "chi2_score", chi2_upper_tail("chi2_score", "_dof").alias("p_value"))
    )


def binned_mutual_info(df: DataFrame, features: Sequence[str], target: str, bins: int = 10, **quantile_options) -> DataFrame:
    """(feature, mutual_info) between exact quantile bins and the class, from counts alone."""
    rows = numbers(df, features, keep=[target]).filter(quoted(target).isNotNull())
    edges = quantile_values(rows, features, [i / bins for i in range(bins + 1)], **quantile_options)
    pairs = rows.select(
        quoted(target).alias("_y"),
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(f).alias("_f"),
                        sum((F.when(quoted(c) > e, 1).otherwise(0) for e in sorted(set(edges[c][1:-1]))), F.lit(0)).alias("_bin"),
                    )
                    for f, c in enumerate(features)
                ]
            )
        ),
    )
    counts = pairs.groupBy("_f", "_bin", "_y").agg(F.count("*").alias("_n"))  # features x bins x classes rows
    names = F.array(*[F.lit(c) for c in features])
    counts = counts.withColumn("feature", F.element_at(names, F.col("_f") + 1))
    total, by_bin, by_class = (
        F.sum("_n").over(Window.partitionBy("feature", *extra)) for extra in ([], ["_bin"], ["_y"])
    )
    placed = counts.select("feature", "_n", total.alias("_all"), by_bin.alias("_b"), by_class.alias("_c"))
    share = F.col("_n") / F.col("_all")
    return placed.groupBy("feature").agg(
        F.greatest(F.sum(share * F.log(F.col("_n") * F.col("_all") / (F.col("_b") * F.col("_c")))), F.lit(0.0)).alias(
            "mutual_info"
        )
    )


def mutual_info(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    id_col: str,
    neighbours: int = NEIGHBOURS,
    seed: int = SEED,
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """(feature, mutual_info): Ross's nearest-neighbour estimator for a class target (2014).

    With N rows, N_c of the own class, k = min(neighbours, N_c - 1), r the distance to
    the k-th neighbour of the own class and m the rows of any class strictly within r:
    MI = psi(N) + mean psi(k) - mean psi(N_c) - mean psi(m), at least 0.

    In one dimension the neighbours are adjacent in sorted order, and m is the
    difference of two running counts, so two distributed sorts replace any comparison of
    pairs. Values become integers on a fine grid, which makes every distance exact.
    """
    rows = numbers(df, features, keep=[id_col, target]).filter(quoted(target).isNotNull())
    sizes = rows.groupBy(quoted(target)).agg(F.count("*").alias("_nc")).filter("_nc > 1")
    n = sizes.agg(F.sum("_nc")).first()[0]
    if n is None:
        raise ValueError("mutual information needs a class of two rows")
    stats = column_stats(rows, features, mean=F.avg, std=F.stddev_pop, low=F.min, high=F.max)

    def on_grid(c: str) -> Column:
        s = stats[c]
        std = s["std"] or 1.0
        reach = max(abs(s["low"] - s["mean"]), abs(s["high"] - s["mean"])) / std + 1.0
        noise = (unit(quoted(id_col), f"{seed}|{c}") * 2 - 1) * JITTER
        return F.round(((quoted(c) - s["mean"]) / std + noise) * (2.0**60 / reach)).cast("bigint")

    points = attach(rows, sizes, [target], how="inner").select(
        quoted(id_col).alias("_id"), quoted(target).alias("_y"), "_nc",
        F.inline(F.array(*[F.struct(F.lit(i).alias("_f"), on_grid(c).alias("_x")) for i, c in enumerate(features)])),
    )
    near = _with_radius(points.filter("_x is not null"), n * len(features), neighbours, window_rows)

    # Each point counts once; two queries per point read how many lie up to either edge.
    # With r = 0 the edges are closed, so that the point's own copies count.
    x, r = F.col("_x"), F.col("_r")
    point = [x, F.lit(1), F.lit(1), F.lit(0)]
    upper = [x + r, F.when(r > 0, 0).otherwise(2), F.lit(0), F.lit(1)]
    lower = [x - r, F.when(r > 0, 2).otherwise(0), F.lit(0), F.lit(-1)]
    events = near.select(
        "_f", "_id", "_nc", "_k",
        F.inline(
            F.array(
                *[
                    F.struct(v.alias("_v"), kind.alias("_kind"), w.cast("bigint").alias("_w"), s.alias("_sign"))
                    for v, kind, w, s in (point, upper, lower)
                ]
            )
        ),
    )
    counted = running_total(
        events, ["_f"], ["_v", "_kind", "_id"], "_w", "_upto", 3 * n * len(features), window_rows
    ).filter("_sign <> 0")
    within = counted.groupBy("_f", "_id", "_nc", "_k").agg(F.sum(F.col("_sign") * F.col("_upto")).alias("_m"))
    score = (
        digamma(F.count("*")) + F.avg(digamma(F.col("_k"))) - F.avg(digamma(F.col("_nc"))) - F.avg(digamma(F.col("_m")))
    )
    names = F.array(*[F.lit(c) for c in features])
    return within.groupBy("_f").agg(F.greatest(score, F.lit(0.0)).alias("mutual_info")).select(
        F.element_at(names, F.col("_f") + 1).alias("feature"), "mutual_info"
    )


def _with_radius(points: DataFrame, rows: int, neighbours: int, window_rows: int) -> DataFrame:
    """Add ``_k`` and ``_r``, the distance to the k-th neighbour of the same class.

    Beyond one window's worth of rows, each class's sorted run is cut into chunks of
    equal length; the few rows next to a cut are copied into the chunk across it.
    """
    keys = ["_f", "_y"]
    if rows <= window_rows:
        laid = points.withColumns({"_chunk": F.lit(0), "_home": F.lit(True)})
    else:
        ranked = rank_rows(points, keys, ["_x", "_id"], "_rank", rows, window_rows)
        at = F.col("_rank") - 1
        chunk, offset = F.floor(at / window_rows), at % window_rows

        def copy(to: Column, home: bool) -> Column:
            return F.struct(to.alias("_chunk"), F.lit(home).alias("_home"))

        laid = ranked.select(
            *points.columns,
            F.inline(
                F.array_compact(
                    F.array(
                        copy(chunk, True),
                        F.when((offset < neighbours) & (chunk > 0), copy(chunk - 1, False)),
                        F.when(offset >= window_rows - neighbours, copy(chunk + 1, False)),
                    )
                )
            ),
        )
    run = Window.partitionBy(*keys, "_chunk").orderBy("_x", "_id")
    steps = range(1, neighbours + 1)
    x = F.col("_x")
    around = [x - F.lag("_x", j).over(run) for j in steps] + [F.lead("_x", j).over(run) - x for j in steps]
    return (
        laid.withColumn("_k", F.least(F.lit(neighbours), F.col("_nc") - 1).cast("int"))
        .withColumn("_r", F.element_at(F.array_sort(F.array_compact(F.array(*around))), F.col("_k")))
        .filter("_home")
        .drop("_chunk", "_home")
    )


def forest_importance(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    trees: int = TREES,
    seed: int = SEED,
    max_depth: int | None = 10,
    id_col: str | None = None,
) -> DataFrame:
    """(feature, importance): impurity importance of a random forest, without a ``max_depth`` of
    one that is grown to pure leaves.

    With an ``id_col`` the same rows give the same forest on any cluster. Without one, rows
    are dealt in turn, since equal ones can't be told apart.
    """
    keep = [target] if id_col is None else [target, id_col]
    rows = numbers(df, features, keep=keep).filter(quoted(target).isNotNull())
    n = df.count()
    if id_col is None:
        order = [quoted(c) for c in (target, *features)]
        rows = rows.repartition(fit_tasks(n, FOREST_ROWS)).sortWithinPartitions(*order)
    else:
        rows = spread(rows, n, [quoted(id_col)], FOREST_ROWS)
    rows = label_encode(rows, target, name="_label").withColumn("_label", F.col("_label").cast("double"))
    if max_depth is None:
        classes = rows.agg(F.max("_label")).first()[0]
        made = fit_forest(rows, features, int(classes or 0) + 1, None, ForestSettings(trees=trees, seed=seed), "_label")
        return df.sparkSession.createDataFrame(list(zip(features, made.importances)), "feature string, importance double")
    # The assembler reads a dot as a struct field, so it is given plain names.
    plain = [f"_f{i}" for i in range(len(features))]
    rows = rows.select("_label", *[quoted(c).alias(p) for c, p in zip(features, plain)])
    vectors = VectorAssembler(inputCols=plain, outputCol="_features").transform(rows).select("_features", "_label")
    forest = RandomForestClassifier(
        featuresCol="_features", labelCol="_label", numTrees=trees, seed=seed, maxDepth=max_depth, cacheNodeIds=True
    ).fit(vectors)
    scores = [(c, float(s)) for c, s in zip(features, forest.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(scores, "feature string, importance double")


def top_features(scores: DataFrame, score: str, k: int = SHOWN_FEATURES) -> DataFrame:
    """The k best features; equal scores are told apart by name."""
    return scores.orderBy(F.desc(score), "feature").limit(k)
