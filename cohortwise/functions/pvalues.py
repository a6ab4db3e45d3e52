"""Tail probabilities of test statistics.

Applied to result tables of a few rows, never to participant rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def chi_square_tail(statistic: float | None, df: float | None) -> float | None:
    """P(X >= statistic) for a chi-square variable with a whole number of degrees of freedom."""
    if statistic is None or df is None or math.isnan(statistic) or math.isnan(df) or df < 1:
        return None
    half = max(float(statistic), 0.0) / 2.0
    if half == 0.0:
        return 1.0
    odd = int(df) % 2
    tail = math.erfc(math.sqrt(half)) if odd else 0.0
    for step in range((int(df) - odd) // 2):
        power = step + odd / 2.0
        tail += math.exp(power * math.log(half) - half - math.lgamma(power + 1.0))
    return min(tail, 1.0)


def normal_two_sided(z: float | None) -> float | None:
    """Two-sided p-value of a standard normal score."""
    if z is None or math.isnan(z):
        return None
    return math.erfc(abs(z) / math.sqrt(2.0))


@F.pandas_udf(DoubleType())
def chi_square_p(statistic: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi_square_tail(s, d) for s, d in zip(statistic.astype(float), df.astype(float))], dtype="float64")
