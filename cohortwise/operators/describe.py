"""Descriptive statistics: quantiles, histograms, densities, box plots, frequencies."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.functions.nulls import null_safe_join
from cohortwise.operators.ranks import order_statistic, quantile_column, quantiles, running_counts, value_counts
from cohortwise.sources.durable import durable


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str], as_type: str = "double") -> DataFrame:
    """Wide to long ``(ids, variable, value)`` with one value type."""
    cast = df.select(*ids, *[F.col(name).cast(as_type).alias(name) for name in columns])
    return cast.unpivot(list(ids), list(columns), "variable", "value")


def quantile_grid(df: DataFrame, key: str, step: float, value: str = "value") -> DataFrame:
    """Type-7 quantiles at 0, step, ..., 1 per key in long form; ``quantile`` is in percent.

    For values with a bounded domain (whole days). Each value row emits the grid
    points whose lower or upper order statistic it is, so the work follows the
    number of different values plus the number of grid points.
    """
    points = round(1 / step)
    counts = value_counts(df, [key], value).filter(F.col("value").isNotNull())
    ranked = running_counts(counts, [key], bounded=True)

    def rank(point: Column) -> Column:
        return (F.col("total") - F.lit(1)) * point / F.lit(float(points))

    def holds(position: Column) -> Column:
        return (F.col("upto") - F.col("n") <= position) & (position < F.col("upto"))

    grid = F.sequence(F.lit(0), F.lit(points))
    hits = F.filter(grid, lambda i: holds(F.floor(rank(i))) | holds(F.ceil(rank(i))))
    cells = ranked.withColumn("point", F.explode(hits))
    number = F.col("value").cast("double")
    low = F.max(F.when(holds(F.floor(rank(F.col("point")))), number))
    high = F.max(F.when(holds(F.ceil(rank(F.col("point")))), number))
    weight = F.max(rank(F.col("point")) - F.floor(rank(F.col("point"))))
    result = cells.groupBy(key, "point").agg((low + (high - low) * weight).alias("value"))
    return result.select(key, (F.col("point") * F.lit(100.0 / points)).alias("quantile"), "value")


def histogram_counts(df: DataFrame, column: str, breaks: Sequence[float]) -> DataFrame:
    """Counts in right-closed bins, the lowest break included; empty bins are listed.

    A value that no bin covers is an error; missing values are not counted.
    """
    value = F.col(column)
    outside = F.count_if((value < breaks[0]) | (value > breaks[-1]))
    refuse = F.raise_error(F.lit(f"values of {column} lie outside the breaks"))
    edges = list(zip(breaks, breaks[1:]))
    cells = []
    for index, (low, high) in enumerate(edges):
        test = (value >= low if index == 0 else value > low) & (value <= high)
        cells.append(F.struct(F.lit(float(low)).alias("lo"), F.lit(float(high)).alias("hi"), F.count_if(test).alias("n")))
    counted = df.agg(F.array(*cells).alias("cells"), outside.alias("outside"))
    return counted.select(F.inline(F.when(F.col("outside") == 0, F.col("cells")).otherwise(refuse)))


def density_grid(df: DataFrame, key: str, value: str = "value", points: int = 512) -> DataFrame:
    """Gaussian kernel density per key on ``points`` equal steps over the pooled range.

    Bandwidth ``0.9 * min(sd, IQR / 1.34) * n ** -0.2``. The kernel sum runs over
    different values with their counts, so its cost follows the value domain
    (whole days) and not the number of participants.
    """
    counts = durable(value_counts(df, [key], value).filter(F.col("value").isNotNull()))
    ranked = running_counts(counts, [key], bounded=True)
    number = F.col("value").cast("double")
    mean = F.sum(number * F.col("n")) / F.sum("n")
    square = F.sum(number * number * F.col("n"))
    spread = ranked.groupBy(key).agg(
        F.sum("n").alias("rows"),
        F.sqrt((square - F.sum("n") * mean * mean) / (F.sum("n") - F.lit(1))).alias("sd"),
        (quantile_column(0.75) - quantile_column(0.25)).alias("iqr"),
    )
    width = F.lit(0.9) * F.least("sd", F.col("iqr") / F.lit(1.34)) * F.pow("rows", F.lit(-0.2))
    scale = spread.select(F.col(key), "rows", width.alias("h"))
    limits = counts.agg(F.struct(F.min("value").alias("low"), F.max("value").alias("high")).alias("limits")).scalar()
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    cells = null_safe_join(counts, scale, [key]).withColumn("limits", limits).withColumn("step", grid)
    low, high = F.col("limits.low"), F.col("limits.high")
    cells = cells.withColumn("x", low + (high - low) * F.col("step") / F.lit(float(points - 1)))
    z = (F.col("x") - number) / F.col("h")
    kernel = F.col("n") * F.exp(F.lit(-0.5) * z * z) / (F.col("rows") * F.col("h") * F.lit(math.sqrt(2 * math.pi)))
    return cells.groupBy(key, "x").agg(F.sum(kernel).alias("density"))


def boxplot_stats(df: DataFrame, keys: Sequence[str], value: str = "value", bucket_by: str | None = None) -> DataFrame:
    """Quartiles and whiskers (last value within 1.5 IQR of the box) per key, nulls ignored."""
    counts = durable(value_counts(df, keys, value).filter(F.col("value").isNotNull()))
    boxes = quantiles(counts, keys, {"q1": 0.25, "median": 0.5, "q3": 0.75}, bucket_by=bucket_by, pinned=True)
    reach = (F.col("q3") - F.col("q1")) * F.lit(1.5)
    joined = null_safe_join(counts, boxes, keys)
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    whisker = F.when(inside, F.col("value"))
    return joined.groupBy(*keys).agg(
        F.min(whisker).cast("double").alias("lower_whisker"),
        F.first("q1").alias("q1"),
        F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        F.max(whisker).cast("double").alias("upper_whisker"),
    )


def _between_neighbours(position: Column) -> Column:
    """Mean of the order statistics around a one-based, possibly half-way position."""
    zero_based = position - F.lit(1)
    return (order_statistic(F.floor(zero_based)) + order_statistic(F.ceil(zero_based))) / F.lit(2.0)


def whisker_limits(df: DataFrame, keys: Sequence[str], value: str = "value", bucket_by: str | None = None) -> DataFrame:
    """Whisker ends by five-number hinges: extreme data within 1.5 hinge spreads of the hinges."""
    counts = durable(value_counts(df, keys, value).filter(F.col("value").isNotNull()))
    ranked = running_counts(counts, keys, bucket_by=bucket_by, pinned=True)
    quarter = F.floor((F.col("total") + F.lit(3)) / F.lit(2)) / F.lit(2.0)
    hinges = ranked.groupBy(*keys).agg(
        _between_neighbours(quarter).alias("low_hinge"),
        _between_neighbours(F.col("total") + F.lit(1) - quarter).alias("high_hinge"),
    )
    reach = (F.col("high_hinge") - F.col("low_hinge")) * F.lit(1.5)
    inside = F.col("value").between(F.col("low_hinge") - reach, F.col("high_hinge") + reach)
    whisker = F.when(inside, F.col("value")).cast("double")
    return null_safe_join(counts, hinges, keys).groupBy(*keys).agg(F.min(whisker).alias("lo"), F.max(whisker).alias("hi"))


def level_frequency(df: DataFrame, columns: Sequence[str], site: str = "site") -> DataFrame:
    """Count of every level, overall (site null) and per site, missing levels included.

    One pass counts (variable, level, site); the overall rows are sums of those counts.
    """
    long = melt(df, [site], [c for c in columns if c != site], "string").withColumnRenamed("value", "level")
    per_site = long.groupBy("variable", site, "level").agg(F.count(F.lit(1)).alias("n"))
    overall = per_site.groupBy("variable", "level").agg(F.sum("n").alias("n"))
    return overall.select("variable", F.lit(None).cast("string").alias(site), "level", "n").unionByName(per_site)


def demographic_summary(df: DataFrame, site: str = "site") -> DataFrame:
    """Size, women, age and education statistics, overall (site null) and per site."""
    grouped = df.groupingSets([[], [F.col(site)]], F.col(site))
    return grouped.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("sex") == "female").alias("n_female"),
        F.avg("age").alias("mean_age"),
        F.stddev_samp("age").alias("sd_age"),
        F.avg("edu_age_align").alias("mean_edu"),
        F.stddev_samp("edu_age_align").alias("sd_edu"),
        F.count_if(F.col("age") < 20).alias("n_under20"),
        F.count_if(F.col("age") > 70).alias("n_over70"),
    )


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum, quartiles, mean and maximum per column, nulls ignored."""
    counts = value_counts(melt(df, [], columns), ["variable"]).filter(F.col("value").isNotNull())
    mean = (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean")
    return quantiles(
        counts,
        ["variable"],
        {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0},
        bucket_by="variable",
        extra=[mean],
    )
