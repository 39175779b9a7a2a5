"""Ranking every numeric feature against a target by three methods."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import quoted, string_columns, with_target
from ..operators.impute import columns_with_nulls, fit_median, quantile_bin
from ..operators.models import feature_names
from ..session import write_out
from ..operators.ranking import (
    KEPT_FEATURES, SHOWN_FEATURES, chi2_scores, forest_importance, mutual_info, top_features,
)


def ranking_input(df: DataFrame, target: str, id_col: str, features: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Rows with a target, medians filled, a numeric target cut into quartiles.

    Columns that are still missing somewhere after the fill had no value at all and are left out.
    """
    names = feature_names(df, target, features, id_col)
    rows = with_target(df, target)
    rows = fit_median(rows, names).apply(rows)
    if target not in string_columns(df):
        rows = quantile_bin(rows, target, name=target)
    gone = set(columns_with_nulls(rows, names))
    kept = [n for n in names if n not in gone]
    rows = rows.select(quoted(id_col), quoted(target), *[quoted(n) for n in kept])
    return write_out(rows, "ranking"), kept  # every method reads it several times


def rank_features(
    df: DataFrame, target: str, id_col: str, features: Sequence[str] | None = None, shown: int = SHOWN_FEATURES,
    **forest_options,
) -> DataFrame:
    """(method, place, feature, score): the best features by each method."""
    rows, names = ranking_input(df, target, id_col, features)
    tables = {
        "mutual_info": mutual_info(rows, names, target, id_col).withColumnRenamed("mutual_info", "score"),
        "chi2": chi2_scores(rows, names, target).select("feature", F.col("chi2_score").alias("score")),
        "forest": forest_importance(rows, names, target, id_col=id_col, **forest_options).withColumnRenamed("importance", "score"),
    }
    best = [top_features(t, "score", shown).withColumn("method", F.lit(m)) for m, t in tables.items()]
    place = F.row_number().over(Window.partitionBy("method").orderBy(F.desc("score"), "feature"))
    return reduce(DataFrame.unionByName, best).select("method", place.alias("place"), "feature", "score")


def select_features(df: DataFrame, target: str, id_col: str, keep: int = KEPT_FEATURES, **forest_options) -> list[str]:
    """Names of the best features by forest importance."""
    rows, names = ranking_input(df, target, id_col)
    scores = forest_importance(rows, names, target, id_col=id_col, **forest_options)
    return [r["feature"] for r in top_features(scores, "importance", keep).collect()]
