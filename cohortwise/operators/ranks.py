"""Exact order statistics without collecting or sorting a group in one task.

Values are counted first (``value_counts``), which folds ties on the map side.
The running count over the ordered values then needs an order within each group.
For a value domain of bounded size (days, scores, ages) one window per group is
enough: it sees one row per different value. For an open domain the values are
cut into buckets at approximate quantiles of the different values; buckets are
summed, the few bucket totals are accumulated per group, and the exact running
count is taken inside each (group, bucket). No task sees more than one bucket of
one group, whatever share of the rows that group holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.functions.nulls import null_safe_join
from cohortwise.functions.spread import bucket_side
from cohortwise.sources.durable import durable

def value_counts(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """``(keys, value, n)``: how often each value occurs; nulls are counted as a value."""
    return df.groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def _with_bucket(counts: DataFrame, by: str | None, side: int) -> DataFrame:
    """Number the bucket of each value among ``side ** 2``, cut at approximate quantiles of the different values.

    The cut points are fetched once (a sketch of bounded size per level of
    ``by``) and enter the plan as literals: every branch and every repeated task
    then puts a value into the same bucket, which the exact counts rely on. A
    bucket is found in two steps of ``side - 1`` comparisons each.
    """
    buckets = side * side
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    levels = counts.groupBy(F.lit("") if by is None else F.col(by)).agg(F.percentile_approx("value", shares, 20 * buckets).alias("edges"))
    cuts = [(level, edges) for level, edges in levels.collect() if level is not None and edges]
    if cuts:
        lookup = F.create_map(*[part for level, edges in cuts for part in (F.lit(level), F.array(*map(F.lit, edges)))])
        edges = F.try_element_at(lookup, F.lit("") if by is None else F.col(by))
    else:
        edges = F.lit(None).cast("array<double>")

    def over(position: Column) -> Column:
        return F.coalesce((F.get("__edges", position) < F.col("value")).cast("int"), F.lit(0))

    coarse = sum((over(F.lit(side * j - 1)) for j in range(1, side)), F.lit(0))
    fine = sum((over(F.col("__coarse") * side + j) for j in range(side - 1)), F.lit(0))
    placed = counts.withColumn("__edges", edges).withColumn("__coarse", coarse)
    return placed.withColumn("__bucket", F.col("__coarse") * side + fine).drop("__edges", "__coarse")


def running_counts(
    counts: DataFrame, keys: Sequence[str], bounded: bool = False, bucket_by: str | None = None, side: int | None = None,
    pinned: bool = False,
) -> DataFrame:
    """Add ``upto`` (rows with a value <= this one) and ``total`` (rows) per group of ``keys``.

    ``counts`` holds non-null values; it may have several rows per value (one per
    subgroup), which then share ``upto``. ``bucket_by`` names a key with a fixed
    small set of levels, such as the variable, that has its own value range.
    The bucketed form reads the counts several times, so they are written to the
    checkpoint folder first unless the caller has ``pinned`` them: the input is
    scanned once, and a lost executor costs a re-read of the counts only.
    """
    if bounded:
        group = Window.partitionBy(*keys)
        return counts.withColumns({"upto": F.sum("n").over(group.orderBy("value")), "total": F.sum("n").over(group)})
    counts = counts.withColumn("value", F.col("value").cast("double"))
    tagged = _with_bucket(counts if pinned else durable(counts), bucket_by, side or bucket_side(counts.sparkSession))
    sums = tagged.groupBy(*keys, "__bucket").agg(F.sum("n").alias("__in_bucket"))
    group = Window.partitionBy(*keys)
    before = F.sum("__in_bucket").over(group.orderBy("__bucket")) - F.col("__in_bucket")
    offsets = sums.select(*keys, "__bucket", before.alias("__before"), F.sum("__in_bucket").over(group).alias("total"))
    inside = Window.partitionBy(*keys, "__bucket").orderBy("value")
    joined = null_safe_join(tagged, offsets, [*keys, "__bucket"])
    return joined.withColumn("upto", F.sum("n").over(inside) + F.col("__before")).drop("__bucket", "__before")


def order_statistic(position: Column) -> Column:
    """Aggregate: the value at a zero-based position of the sorted group."""
    hit = (F.col("upto") - F.col("n") <= position) & (position < F.col("upto"))
    return F.max(F.when(hit, F.col("value")))


def quantile_column(share: float | Column) -> Column:
    """Aggregate: type-7 quantile (linear interpolation at ``(total - 1) * share``)."""
    rank = (F.col("total") - F.lit(1)) * (F.lit(share) if isinstance(share, float) else share)
    low = order_statistic(F.floor(rank))
    high = order_statistic(F.ceil(rank))
    weight = F.max(rank - F.floor(rank))
    return low + (high - low) * weight


def quantiles(
    counts: DataFrame, keys: Sequence[str], shares: dict[str, float], bounded: bool = False, bucket_by: str | None = None,
    extra: Sequence[Column] = (), pinned: bool = False,
) -> DataFrame:
    """Exact quantiles per group from value counts; ``shares`` maps column name to probability."""
    ranked = running_counts(counts.filter(F.col("value").isNotNull()), keys, bounded, bucket_by, pinned=pinned)
    return ranked.groupBy(*keys).agg(*[quantile_column(float(p)).alias(name) for name, p in shares.items()], *extra)


def rank_sums(counts: DataFrame, variable: str, group: str, bounded: bool = False, pinned: bool = False) -> DataFrame:
    """Sum of average ranks and number of rows per variable and group, with the tie sum of the variable.

    ``counts`` is ``(variable, group, value, n)`` without null values or groups.
    """
    ranked = running_counts(counts, [variable], bounded, None if bounded else variable, pinned=pinned)
    tied = F.sum("n").over(Window.partitionBy(variable, "value"))
    scored = ranked.withColumn("__tied", tied).withColumn(
        "__rank", F.col("upto") - F.col("__tied") + (F.col("__tied") + F.lit(1)) / F.lit(2.0)
    )
    share = F.col("n").cast("double") * (F.col("__tied").cast("double") * F.col("__tied") - F.lit(1))
    return scored.groupBy(variable, group).agg(
        F.sum(F.col("n") * F.col("__rank")).alias("rank_sum"),
        F.sum("n").alias("n"),
        F.sum(share).alias("tie_part"),
        F.max("total").alias("total"),
    )
