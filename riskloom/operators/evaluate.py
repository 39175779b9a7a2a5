"""Metrics from one confusion table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def confusion(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """(label, prediction, n): the only pass over the rows; classes squared in size."""
    return df.groupBy(*by, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count("*").alias("n")
    )


def per_class(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where a ratio has no base."""
    sides = table.select(
        *by,
        F.inline(
            F.array(
                F.struct(
                    F.col("label").alias("class"), F.col("n").alias("_support"), F.lit(0).cast("bigint").alias("_claimed"),
                    F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("_hits"),
                ),
                F.struct(
                    F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("_support"),
                    F.col("n").alias("_claimed"), F.lit(0).cast("bigint").alias("_hits"),
                ),
            )
        ),
    )
    sums = sides.groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("_support", "_claimed", "_hits")])
    hits, claimed, support = F.col("_hits"), F.col("_claimed"), F.col("_support")
    zero = F.lit(0.0)
    return sums.select(
        *by, "class",
        F.coalesce(F.try_divide(hits, claimed), zero).alias("precision"),
        F.coalesce(F.try_divide(hits, support), zero).alias("recall"),
        F.coalesce(F.try_divide(2 * hits, claimed + support), zero).alias("f1"),
        support.alias("support"), hits.alias("_hits"),
    )


def _summary(classes: DataFrame, by: Sequence[str]) -> DataFrame:
    total = F.sum("support")
    weighted = [F.try_divide(F.sum(F.col(m) * F.col("support")), total).alias(f"weighted_{m}") for m in MEASURES]
    plain = [F.avg(m).alias(f"macro_{m}") for m in MEASURES]
    return classes.groupBy(*by).agg(
        F.try_divide(F.sum("_hits"), total).alias("accuracy"), *weighted, *plain, total.alias("support")
    )


MEASURES = ["precision", "recall", "f1"]


def metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1."""
    return metrics_of(confusion(df, label, prediction, by), by)


def metrics_of(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``metrics`` from a confusion table."""
    summary = _summary(per_class(table, by), by)
    return summary.select(*by, "accuracy", *[F.col(f"weighted_{m}").alias(m) for m in MEASURES])


def classification_report(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """A row per class, then accuracy, macro average and weighted average."""
    return report_of(confusion(df, label, prediction, by), by)


def report_of(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``classification_report`` from a confusion table."""
    classes = per_class(table, by)
    summary = _summary(classes, by)

    def tail(name: str, columns: list) -> F.Column:
        return F.struct(
            F.lit(name).alias("class"), *[c.cast("double").alias(m) for c, m in zip(columns, MEASURES)], F.col("support")
        )

    rows = summary.select(
        *by,
        F.inline(
            F.array(
                tail("accuracy", [F.lit(None), F.lit(None), F.col("accuracy")]),
                tail("macro avg", [F.col(f"macro_{m}") for m in MEASURES]),
                tail("weighted avg", [F.col(f"weighted_{m}") for m in MEASURES]),
            )
        ),
    )
    named = classes.select(*by, F.col("class").cast("string").alias("class"), *MEASURES, "support")
    return named.unionByName(rows)
