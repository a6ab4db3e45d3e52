"""Concordance of a risk score with times to an event, by exact distributed pair counting.

A pair is comparable when one side has an event and the other outlasts it (ends
later, or is censored on the same day); it is concordant when the earlier event
has the higher risk. Rows are first counted by (risk, day, event), then dealt by
ranges of the risk into buckets of about ``bucket_rows`` counts, whatever their number; equal risks
always share a bucket. Pairs from two buckets come from prefix sums on two
levels: over the days of a bucket (who outlasts a day), and for each day over the buckets below.
Pairs inside a bucket come from a sorted merge count in NumPy: for each bit of the place in
time, rows of the later half are accumulated by risk under those of the earlier half.
No pair is written out, and the driver sees one row per model.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.sources.durable import durable

BUCKET_ROWS = 200_000
_WIDE = "decimal(38,0)"


def concordance(scored: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(model, concordance, pairs)`` from ``(model, time, event, risk)``; times are whole days.

    Models without a comparable pair have a null concordance.
    """
    counts = durable(scored.groupBy("model", "risk", "time", "event").agg(F.count(F.lit(1)).alias("n")))
    on_event = F.when(F.col("event") == 1, F.col("time"))
    spans = counts.groupBy("model").agg(F.count(F.lit(1)).alias("rows"), F.min(on_event).alias("low"), F.max(on_event).alias("high")).collect()
    buckets = max(1, math.ceil(sum(s.rows for s in spans) / bucket_rows))
    dealt = durable(counts.repartitionByRange(buckets, "model", "risk").withColumn("bucket", F.spark_partition_id()))
    inside = dealt.groupBy("model", "bucket").applyInArrow(_inside_bucket, "model string, lower bigint, tied bigint, pairs bigint")
    summed = _across_buckets(dealt, spans).unionByName(inside).groupBy("model").agg(*[F.sum(F.col(c).cast(_WIDE)).alias(c) for c in ("lower", "tied", "pairs")])
    score = (F.col("lower").cast("double") + F.col("tied").cast("double") / F.lit(2.0)) / F.col("pairs").cast("double")
    return summed.select("model", F.when(F.col("pairs") > 0, score).alias("concordance"), F.col("pairs").cast("double").alias("pairs"))


def _across_buckets(dealt: DataFrame, spans: list) -> DataFrame:
    """Pairs whose sides lie in different buckets, one row per model.

    The grid has a cell per bucket and day between a model's first and last event: rows / ``bucket_rows`` x follow-up.
    """
    cells = dealt.groupBy("model", "bucket", "time").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("event") == 0, F.col("n")).otherwise(F.lit(0))).alias("censored"))
    low, high = (F.create_map(*[F.lit(v) for s in spans for v in (s.model, s[edge])]) if spans else F.create_map(F.lit(""), F.lit(None).cast("int")) for edge in ("low", "high"))
    bounds = {"low": F.try_element_at(low, F.col("model")).cast("int"), "high": F.try_element_at(high, F.col("model")).cast("int")}
    days = dealt.select("model", "bucket").distinct().withColumns(bounds).where("low IS NOT NULL").select("model", "bucket", F.explode(F.sequence("low", "high")).alias("time"))
    grid = cells.unionByName(days.withColumns({"n": F.lit(0).cast("bigint"), "censored": F.lit(0).cast("bigint")}))
    grid = grid.groupBy("model", "bucket", "time").agg(F.sum("n").alias("n"), F.sum("censored").alias("censored"))
    backwards = Window.partitionBy("model", "bucket").orderBy(F.desc("time"))
    outlasting = grid.withColumn("later", F.sum("n").over(backwards) - F.col("n") + F.col("censored")).withColumns(bounds).where(F.col("time").between(F.col("low"), F.col("high")))
    day = Window.partitionBy("model", "time")
    placed = outlasting.withColumns({"below": F.sum("later").over(day.orderBy("bucket")) - F.col("later"), "others": F.sum("later").over(day) - F.col("later")})
    deaths = (F.col("n") - F.col("censored")).cast("decimal(19,0)")
    return placed.groupBy("model").agg(
        F.sum(deaths * F.col("below").cast("decimal(19,0)")).cast(_WIDE).alias("lower"),
        F.lit(0).cast(_WIDE).alias("tied"),
        F.sum(deaths * F.col("others").cast("decimal(19,0)")).cast(_WIDE).alias("pairs"),
    )


def _starts(*keys: np.ndarray) -> np.ndarray:
    """For each row of sorted keys the place where its group begins."""
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def merge_count(time: np.ndarray, event: np.ndarray, risk: np.ndarray, n: np.ndarray) -> tuple[int, int, int]:
    """Comparable pairs with a lower risk on the outlasting side, with equal risks, and all of them."""
    _, place = np.unique(event - 2 * time, return_inverse=True)  # latest first, censored before events of a day
    _, rank = np.unique(risk, return_inverse=True)
    died = np.where(event == 1, n, 0)

    def before(order: np.ndarray, weight: np.ndarray, fine: tuple, coarse: tuple) -> int:
        total = np.concatenate([[0], np.cumsum(weight[order])])
        first = _starts(*[k[order] for k in coarse]) if coarse else np.zeros(len(order), np.int64)
        return total[_starts(*[k[order] for k in fine])] - total[first]

    order = np.argsort(place, kind="stable")
    pairs = int(np.dot(died[order], before(order, n, (place,), ())))
    order = np.lexsort((place, rank))
    tied = int(np.dot(died[order], before(order, n, (rank, place), (rank,))))
    by_risk = np.argsort(rank, kind="stable")
    lower = 0
    for bit in range(int(place.max(initial=0)).bit_length()):
        half, block = (place >> bit) & 1, place >> (bit + 1)
        order = by_risk[np.argsort(block[by_risk], kind="stable")]
        earlier = np.where(half == 1, died, 0)  # a later place is an earlier day
        lower += int(np.dot(earlier[order], before(order, np.where(half == 0, n, 0), (block, rank), (block,))))
    return lower, tied, pairs


def _inside_bucket(part: pa.Table) -> pa.Table:
    columns = (part[c].to_numpy().astype(np.int64) for c in ("time", "event"))
    lower, tied, pairs = merge_count(*columns, part["risk"].to_numpy(), part["n"].to_numpy())
    return pa.table({"model": pa.array([part["model"][0].as_py()], pa.string()), "lower": [lower], "tied": [tied], "pairs": [pairs]})
