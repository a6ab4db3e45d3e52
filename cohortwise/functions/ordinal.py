"""Gapless positions in a global order, without a window over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.functions.nulls import null_safe_join
from cohortwise.sources.durable import durable


def with_positions(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), name: str = "position") -> DataFrame:
    """Add the one-based place of each row within its group ``by``, in the given order (nulls first).

    Rows are dealt by ranges of (group, order) and written down, so the ranges stay as they are for all that follows.
    Each range numbers its own rows; the places before it are the sizes of earlier ranges, one row a range. A group of
    any size is spread over as many ranges as its share of the rows. Rows equal in ``order`` share a range and
    are numbered in no particular order among themselves.
    """
    keys = [f"__order_{i}" for i in range(len(order))]
    keyed = df.withColumns(dict(zip(keys, order)))
    ranges = durable(keyed.repartitionByRange(*by, *keys).withColumn("__range", F.spark_partition_id()))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # over one row a range
    sizes = ranges.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__rows"))
    before = sizes.select(*by, "__range", (F.sum("__rows").over(group.orderBy("__range")) - F.col("__rows")).alias("__before"))
    within = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(*keys))
    joined = null_safe_join(ranges.withColumn("__within", within), before, [*by, "__range"])
    return joined.withColumn(name, F.col("__before") + F.col("__within")).select(*df.columns, name)
