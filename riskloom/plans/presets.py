"""Preprocessing presets: named steps run in order over one table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from ..functions.columns import core_columns, present
from ..operators.encode import listed_categories, one_hot
from ..operators.outliers import cap_outliers
from ..operators.transform import fit_log_transform, fit_standard_scale

Step = Callable[[DataFrame, Sequence[str]], DataFrame]

STEPS: dict[str, Step] = {
    "scale": lambda df, columns: fit_standard_scale(df, columns).apply(df),
    "log": lambda df, columns: fit_log_transform(df, columns).apply(df),
    "log_skewed": lambda df, columns: fit_log_transform(df, columns, only_skewed=True).apply(df),
    "cap": lambda df, columns: cap_outliers(df, columns),
    "encode": lambda df, columns: one_hot(df, listed_categories(df)),
}
PRESETS = {
    "scale_log": ["scale", "log"],  # what one pass over all preprocessing steps leaves behind
    "full": ["cap", "log", "scale", "encode"],
}


def preprocess(
    df: DataFrame, preset: str | Sequence[str] = "scale_log", columns: Sequence[str] | None = None
) -> DataFrame:
    """Run a preset, or a list of step names, on the core columns (or the given ones)."""
    columns = present(df, columns) if columns is not None else core_columns(df)
    for step in PRESETS[preset] if isinstance(preset, str) else preset:
        df = STEPS[step](df, columns)
    return df
