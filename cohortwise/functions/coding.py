"""Recoding of categories, ordered bands, scores and factor levels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def recode(column: Column | str, labels: Mapping, keep_unmapped: bool = True) -> Column:
    """Code to label; an unmapped code keeps its own text or becomes null."""
    value = _column(column)
    result = None
    for code, label in labels.items():
        result = F.when(value == F.lit(code), F.lit(label)) if result is None else result.when(value == F.lit(code), F.lit(label))
    return result.otherwise(value.cast("string") if keep_unmapped else F.lit(None).cast("string"))


def collapse(column: Column | str, groups: Mapping[str, Sequence], missing: str | None = None) -> Column:
    """Put several categories under one label; everything else gets ``missing``."""
    value = _column(column)
    result = None
    for label, members in groups.items():
        test = value.isin(list(members))
        result = F.when(test, F.lit(label)) if result is None else result.when(test, F.lit(label))
    return result.otherwise(F.lit(missing).cast("string"))


def keep_listed(column: Column | str, allowed: Sequence) -> Column:
    """The value when it is listed, else null."""
    value = _column(column)
    return F.when(value.isin(list(allowed)), value)


def flag(column: Column | str, value=1) -> Column:
    """1 where the column equals ``value``, otherwise 0 (also for null)."""
    return F.when(_column(column) == F.lit(value), F.lit(1)).otherwise(F.lit(0))


def upper_bands(column: Column | str, edges: Sequence[tuple[float, str]], beyond: str, missing_is_beyond: bool = False) -> Column:
    """Bands given by inclusive upper edges in rising order.

    A value over the last edge gets ``beyond``. A missing value is null, or
    ``beyond`` with ``missing_is_beyond``, which is what assigning the top band
    first and overwriting it afterwards yields.
    """
    value = _column(column)
    result = F.when(value <= F.lit(edges[0][0]), F.lit(edges[0][1]))
    for edge, label in edges[1:]:
        result = result.when(value <= F.lit(edge), F.lit(label))
    return result.otherwise(F.lit(beyond)) if missing_is_beyond else result.when(value.isNotNull(), F.lit(beyond))


def lower_bands(column: Column | str, edges: Sequence[tuple[float, str]]) -> Column:
    """Bands given by inclusive lower edges in rising order; below the first or missing: null."""
    value = _column(column)
    result = None
    for edge, label in reversed(edges):
        test = value >= F.lit(edge)
        result = F.when(test, F.lit(label)) if result is None else result.when(test, F.lit(label))
    return result


def cap(column: Column | str, limit) -> Column:
    """The value, at most ``limit``; null stays null."""
    value = _column(column)
    return F.when(value >= F.lit(limit), F.lit(limit)).otherwise(value)


def drop_above(column: Column | str, limit) -> Column:
    """Null out impossible values above ``limit``."""
    value = _column(column)
    return F.when(value <= F.lit(limit), value)


def item_sum(columns: Sequence[str], reversed_items: Sequence[str] = (), top: int = 3) -> Column:
    """Questionnaire score; listed items count as ``top - value``. Null if any item is null."""
    total = None
    for name in columns:
        part = F.lit(top) - F.col(name) if name in reversed_items else F.col(name)
        total = part if total is None else total + part
    return total


def any_positive(column: Column | str) -> Column:
    """1 above zero, 0 at zero, null otherwise."""
    value = _column(column)
    return F.when(value > 0, F.lit(1)).when(value == 0, F.lit(0))


def level_position(column: Column | str, levels: Sequence) -> Column:
    """One-based position in an ordered level list; null outside it."""
    position = F.array_position(F.array(*[F.lit(level) for level in levels]), _column(column))
    return F.when(position > 0, position.cast("int"))


def one_hot(column: Column | str, levels: Sequence, drop_reference: bool = True) -> list[Column]:
    """0/1 doubles for each level but the first; null for a value outside the levels."""
    value = _column(column)
    known = value.isin(list(levels))
    kept = list(levels)[1:] if drop_reference else list(levels)
    return [F.when(known, (value == F.lit(level)).cast("double")) for level in kept]
