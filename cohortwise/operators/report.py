"""Text forms of numeric result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounded_text(column: Column | str, digits: int = 2) -> Column:
    """Half-even rounding written without trailing zeros, as in "0.5" or "12"."""
    value = F.col(column) if isinstance(column, str) else column
    text = F.format_string(f"%.{digits}f", F.bround(value, digits))
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def hazard_ratio_report(coefficients: DataFrame) -> DataFrame:
    """``model, term, hr_text, p_text``: "ratio (low-high)" and the p-value, two digits."""
    text = F.concat(rounded_text("hr"), F.lit(" ("), rounded_text("lower"), F.lit("-"), rounded_text("upper"), F.lit(")"))
    return coefficients.select("model", "term", text.alias("hr_text"), rounded_text("p").alias("p_text"))
