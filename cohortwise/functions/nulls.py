"""Null-aware aggregates and predicates.

The analyses treat a missing value as *unknown*: an aggregate over a group with
one unknown value is unknown. Spark's aggregates skip nulls, hence the wrappers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strict(aggregate: Callable[[Column], Column], column: Column | str) -> Column:
    """``aggregate(column)``, or null when the group holds any null."""
    value = F.col(column) if isinstance(column, str) else column
    return F.when(F.count(F.lit(1)) == F.count(value), aggregate(value))


def within(column: Column | str, values: Iterable) -> Column:
    """Membership test that is false (not null) for a null value."""
    value = F.col(column) if isinstance(column, str) else column
    return F.coalesce(value.isin(list(values)), F.lit(False))


def not_within(column: Column | str, values: Iterable) -> Column:
    """Non-membership; a null value is kept."""
    return ~within(column, values)


def count_distinct_with_null(column: Column | str) -> Column:
    """Distinct count in which null is one of the values."""
    value = F.col(column) if isinstance(column, str) else column
    return F.count_distinct(value) + F.coalesce(F.max(value.isNull().cast("bigint")), F.lit(0))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which null keys match null keys; keys come from the left side.

    ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``. Spark turns
    ``<=>`` into a hash or merge join, so this costs the same as a plain join.
    """
    renamed = right.withColumnsRenamed({key: f"__right_{key}" for key in keys})
    condition = None
    for key in keys:
        part = left[key].eqNullSafe(renamed[f"__right_{key}"])
        condition = part if condition is None else condition & part
    return left.join(renamed, condition, how).drop(*[f"__right_{key}" for key in keys])
