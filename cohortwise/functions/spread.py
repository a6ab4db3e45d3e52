"""Joins and buckets that stay even when one key holds a large part of the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.functions.nulls import null_safe_join


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def salts(spark: SparkSession) -> int:
    """Number of parts a key's rows are spread over; grows with the cluster's shuffle width.

    The small side is shuffled once for every part, so there are no more of them than keep a key with a third of all rows
    near the size of an average partition.
    """
    return max(8, min(128, _partitions(spark) // 16))


def bucket_side(spark: SparkSession) -> int:
    """Square root of the number of value buckets; grows with the shuffle width as well."""
    return max(8, math.isqrt(_partitions(spark)))


def spread_join(
    large: DataFrame, small: DataFrame, keys: Sequence[str], how: str, spread_by: Sequence[str], parts: int | None = None
) -> DataFrame:
    """Null-safe join of event rows with a one-row-per-key table, the rows of a key spread over many tasks.

    Each large row gets a salt from a hash of ``spread_by`` (the same on every
    attempt of a task), and the small side is repeated for every salt. Without
    this, an aggregate on the same key right after the join would reuse the
    join's partitioning and leave all rows of one key to one task.
    """
    count = parts or salts(large.sparkSession)
    salted = large.withColumn("__salt", F.pmod(F.xxhash64(*spread_by), F.lit(count)).cast("int"))
    repeated = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return null_safe_join(salted, repeated, [*keys, "__salt"], how).drop("__salt")


def hot_keys(large: DataFrame, keys: Sequence[str], rows_per_part: int | None = None) -> DataFrame:
    """``(keys, __parts)`` of the keys with more than ``rows_per_part`` rows, and how many parts their rows make.

    Without a number a part holds a quarter of what a shuffle partition would get on average, so there are at most four
    times as many hot keys as shuffle partitions: small enough for every task. Counting folds on the map side.
    """
    counts = large.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    if rows_per_part is None:
        total = large.count()
        rows_per_part = max(10_000, total // (4 * _partitions(large.sparkSession)))
    return counts.filter(F.col("__rows") > rows_per_part).select(*keys, F.ceil(F.col("__rows") / F.lit(rows_per_part)).cast("int").alias("__parts"))


def hot_join(
    large: DataFrame, small: DataFrame, keys: Sequence[str], how: str, spread_by: Sequence[str], rows_per_part: int | None = None
) -> DataFrame:
    """Null-safe join of a written table with a one-row-per-key table, split for the hot keys only.

    ``large`` is read twice, so it should be written down first. Rows of a hot key are dealt to its parts by a hash of ``spread_by``
    (the same on every attempt of a task), and only the hot rows of the small side are repeated. There is no bound on the parts.
    """
    hot = hot_keys(large, keys, rows_per_part)
    parts = F.coalesce("__parts", F.lit(1))
    salted = null_safe_join(large, F.broadcast(hot), keys, "left").withColumn("__salt", F.pmod(F.xxhash64(*spread_by), parts).cast("int")).drop("__parts")
    repeated = null_safe_join(small, F.broadcast(hot), keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return null_safe_join(salted, repeated, [*keys, "__salt"], how).drop("__salt")
