"""Column expressions shared by the operators."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

KEY_BITS = 60  # fifteen hex digits: the most that fit a signed long


def hash_key(row_id: Column, seed: int | str) -> Column:
    """A uniform 60-bit integer from a row's id, the same in every run and engine."""
    digest = F.md5(F.concat_ws("|", row_id.cast("string"), F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("bigint")


def unit(row_id: Column, seed: int | str) -> Column:
    """A uniform double in [0, 1) from a row's id."""
    return hash_key(row_id, seed) / F.lit(float(2**KEY_BITS))


def clip(value: Column, low: Column, high: Column) -> Column:
    """Limit to [low, high]; NULL stays NULL (greatest/least would fill it)."""
    return F.when(value < low, low).when(value > high, high).otherwise(value)


def log_shift(low: float | None) -> float:
    """What to add before log1p so that the smallest value becomes positive."""
    return abs(low) + 1.0 if low is not None and low <= 0 else 0.0


def adjusted_skewness(value: Column, n: Column) -> Column:
    """Sample skewness G1: NULL under three values, 0 for a constant column."""
    factor = F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0))
    return F.when(n < 3, F.lit(None)).when(F.min(value) == F.max(value), F.lit(0.0)).otherwise(
        F.skewness(value) * factor
    ).cast("double")


def digamma(n: Column) -> Column:
    """psi(n) for positive n: six steps of the recurrence, then the asymptotic series."""
    y = n.cast("double") + 6
    tail = F.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6)
    return tail - reduce(lambda a, b: a + b, [1 / (n.cast("double") + j) for j in range(6)])


def fixed(value: Column, places: int = 4) -> Column:
    """Fixed-decimal text, as the display tables show it.

    Java formats the shortest decimal form half up; Python and C round the binary value
    itself. The difference shows on ties such as 0.00005, so the scaled value is taken
    exactly (product plus its rounding error, by Dekker's splitting) and rounded first.
    """
    size, scale = F.abs(value), float(10**places)
    product = size * scale
    split = size * 134217729.0  # 2**27 + 1
    high = split - (split - size)
    error = (high * scale - product) + (size - high) * scale
    whole = F.floor(product)
    rest = product - whole
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    rounded = (whole + F.when(up, 1).otherwise(0)) / F.lit(scale)
    shown = F.when(product < 2.0**52, rounded).otherwise(size)
    return F.when(value.isNotNull(), F.format_string(f"%.{places}f", F.when(value < 0, -shown).otherwise(shown)))


def _upper_tail(score: float, dof: int) -> float:
    """Chi-squared survival function by the recurrence Q(a+1,x) = Q(a,x) + x^a e^-x / Gamma(a+1)."""
    if pd.isna(score) or dof < 1:
        return math.nan
    x = max(score, 0.0) / 2
    a = 1.0 if dof % 2 == 0 else 0.5
    q = math.exp(-x) if dof % 2 == 0 else math.erfc(math.sqrt(x))
    while a < dof / 2:
        if x > 0:
            q += math.exp(a * math.log(x) - x - math.lgamma(a + 1))
        a += 1
    return min(q, 1.0)


@F.pandas_udf(T.DoubleType())
def chi2_upper_tail(score: pd.Series, dof: pd.Series) -> pd.Series:
    """Runs on one row per feature: no SQL function gives erfc for odd degrees of freedom."""
    return pd.Series([_upper_tail(s, int(d)) for s, d in zip(score, dof)])
