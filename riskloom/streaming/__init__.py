"""Fitted steps on streams.

A fitted step is a projection of literals, so it takes a streaming table as it is:
fit on a batch, then apply the same steps to ``spark.readStream``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.transform import FittedStep


def apply_steps(df: DataFrame, steps: Sequence[FittedStep]) -> DataFrame:
    for step in steps:
        df = step.apply(df)
    return df
