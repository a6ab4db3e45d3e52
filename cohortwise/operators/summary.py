"""Per-participant summaries: surveys, contacts, clinical visits, baselines."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.functions.calendar import day_in_study, epoch_seconds_to_ts, seconds_between, week_from_zero
from cohortwise.functions.coding import any_positive, item_sum
from cohortwise.functions.nulls import null_safe_join, strict
from cohortwise.operators.align import attach_enrollment
from cohortwise.operators.ranks import quantile_column, running_counts, value_counts
from cohortwise.sources.durable import durable

# Questionnaire items and the reverse-scored ones.
PHQ8_ITEMS = tuple(f"s_{i}" for i in range(1, 9))
RSES_ITEMS = tuple(f"s_{i}" for i in range(1, 11))
RSES_REVERSED = ("s_2", "s_5", "s_6", "s_8", "s_9")
NO_NOTIFICATION = -1
MOST_RECORDS = 50_000


def clean_notifications(raw: DataFrame, activity: str | None = None) -> DataFrame:
    """Epoch columns to instants, the "no notification" code to null, lag and completion time in seconds."""
    notified = F.nullif(F.col("notification_time"), F.lit(NO_NOTIFICATION))
    cleaned = raw.withColumns(
        {
            "notification_time": epoch_seconds_to_ts(notified),
            "start_time": epoch_seconds_to_ts("start_time"),
            "end_time": epoch_seconds_to_ts("end_time"),
        }
    )
    timed = cleaned.withColumns(
        {
            "response_lag": seconds_between("start_time", "notification_time"),
            "total_time_taken": seconds_between("end_time", "start_time"),
        }
    )
    return timed if activity is None else timed.withColumn("activity", F.lit(activity))


def score_surveys(records: DataFrame) -> DataFrame:
    """Add ``sum_phq8`` and ``sum_rses`` where the items for them are present."""
    names = set(records.columns)
    scores = {}
    if set(PHQ8_ITEMS) <= names:
        scores["sum_phq8"] = item_sum(PHQ8_ITEMS)
    if set(RSES_ITEMS) <= names:
        scores["sum_rses"] = item_sum(RSES_ITEMS, RSES_REVERSED)
    return records.withColumns(scores)


def index_surveys(records: DataFrame, enrollment: DataFrame, how: str = "left") -> DataFrame:
    """Join of the enrolment date with ``days`` (one-based) and ``week``; a left join keeps unmatched rows with null days."""
    return index_dated(attach_enrollment(records, enrollment, ["start_time", "total_time_taken"], how))


def index_dated(records: DataFrame) -> DataFrame:
    """``days`` and ``week`` of records that carry the enrolment date."""
    days = day_in_study(F.to_date("start_time"), "enrollment_date")
    return records.withColumn("days", days).withColumn("week", week_from_zero("days"))


def contact_count(contacts: DataFrame, enrollment: DataFrame, horizon: int) -> DataFrame:
    """Highest contact number up to the horizon (contacts before enrolment included); unknown counts as 0.

    The log is reduced to one row per participant and day first.
    """
    daily = contacts.groupBy("p_id", "date").agg(strict(F.max, "record_num").alias("record_num"))
    inside = attach_enrollment(daily, enrollment).filter(day_in_study("date", "enrollment_date") <= horizon)
    return inside.groupBy("p_id").agg(F.coalesce(strict(F.max, "record_num"), F.lit(0)).alias("num_contact"))


def visits_in_period(visits: DataFrame, enrollment: DataFrame, horizon: int) -> DataFrame:
    """Visits up to the horizon plus the baseline visit whenever it took place."""
    day = day_in_study("date", "enrollment_date")
    return attach_enrollment(visits, enrollment, ["date", "record_num"]).filter((day <= horizon) | (F.col("record_num") == 0))


def visit_summary(visits: DataFrame, enrollment: DataFrame, horizon: int, score: str = "ids_score") -> DataFrame:
    """Number of visits in the period and the baseline (record 0) score."""
    return visits_in_period(visits, enrollment, horizon).groupBy("p_id").agg(
        F.count(F.lit(1)).alias("count_ids"),
        F.max(F.when(F.col("record_num") == 0, F.col(score))).alias("baseline_ids"),
    )


def baseline_first(records: DataFrame, score: str, tie_break: Sequence[str] = ()) -> DataFrame:
    """Score of the earliest record; records without a start time are left out, ties go by ``tie_break``."""
    order = F.struct("start_time", *tie_break, score)
    return (
        records.filter(F.col("start_time").isNotNull()).groupBy("p_id").agg(F.min_by(score, order).alias(score))
    )


def baseline_max(indexed: DataFrame, *scores: str, weeks: Sequence[int] = (1, 2)) -> DataFrame:
    """Highest score of each kind in the first weeks, from one pass; null when one of the scores of that kind is missing."""
    early = indexed.filter(F.col("week").isin(list(weeks)))
    return early.groupBy("p_id").agg(*[strict(F.max, score).alias(score) for score in scores])


def in_period(indexed: DataFrame, horizon: int, weeks: Sequence[int] = (1, 2)) -> DataFrame:
    """The records that a period summary or a baseline reads, written down, so that several of them share one pass over all records."""
    return durable(indexed.filter((F.col("days") <= horizon) | F.col("week").isin(list(weeks))))


def baseline_top1(indexed: DataFrame, score: str, keep: Sequence[str] = (), weeks: Sequence[int] = (1, 2), order: Sequence[str] = ()) -> DataFrame:
    """The record with the highest score in the first weeks, missing scores ignored, ties by ``order``.

    Written as ``max_by`` over (score, tie keys), which combines on the map side
    where a row number would sort each participant's records.
    """
    early = indexed.filter(F.col("week").isin(list(weeks)) & F.col(score).isNotNull())
    rank = F.struct(F.col(score), *[-F.col(name).cast("double") for name in order])
    columns = [F.max_by(F.col(name), rank).alias(name) for name in (score, *keep)]
    return early.groupBy("p_id").agg(*columns)


def _median(column: str) -> Column:
    """Aggregate: median of a group of bounded size."""
    values = F.sort_array(F.collect_list(column))
    size = F.count(column)
    low, high = F.get(values, F.floor((size - 1) / 2).cast("int")), F.get(values, F.floor(size / 2).cast("int"))
    return low + (high - low) * F.lit(0.5)


def survey_period_summary(
    indexed: DataFrame, horizon: int, columns: dict[str, tuple[str, str]], pinned: bool = False, most: int = MOST_RECORDS
) -> DataFrame:
    """Mean or median of survey columns per participant up to the horizon.

    ``columns`` maps output name to ``(column, "mean" | "median")``. A missing
    value makes the result unknown. The records are written down unless the caller has ``pinned`` them. Participants
    with at most ``most`` records are one group each; records of the others are folded to value counts keyed by
    (participant, column, value), so a participant with very many records is not one task's work.
    """
    sources = sorted({column for column, _ in columns.values()})
    inside = indexed.filter(F.col("days") <= horizon).select("p_id", *[F.col(name).cast("double").alias(name) for name in sources])
    inside = inside if pinned else durable(inside)
    sizes = inside.groupBy("p_id").agg(F.count(F.lit(1)).alias("__n"))
    large = [row.p_id for row in sizes.filter(F.col("__n") > most).select("p_id").collect()]  # one in ``most`` records at most
    named = inside
    if large:
        hot = inside.sparkSession.createDataFrame([(p,) for p in large], inside.select("p_id").schema)
        named = null_safe_join(inside, F.broadcast(hot), ["p_id"], "left_anti")
    outputs = []
    for name, (column, statistic) in columns.items():
        outputs.append(strict(F.avg if statistic == "mean" else lambda c: _median(column), column).alias(name))
    result = named.groupBy("p_id").agg(*outputs)
    return result.unionByName(_counted_summary(null_safe_join(inside, F.broadcast(hot), ["p_id"], "left_semi"), sources, columns)) if large else result


def _counted_summary(inside: DataFrame, sources: Sequence[str], columns: dict[str, tuple[str, str]]) -> DataFrame:
    """The same from value counts."""
    long = inside.unpivot("p_id", list(sources), "variable", "value")
    counts = value_counts(long, ["p_id", "variable"])
    ranked = running_counts(counts, ["p_id", "variable"], bucket_by="variable")
    known = F.max(F.col("value").isNull().cast("int")) == 0
    stats = ranked.groupBy("p_id", "variable").agg(
        F.when(known, F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"),
        F.when(known, quantile_column(0.5)).alias("median"),
    )
    outputs = [
        F.max(F.when(F.col("variable") == column, F.col(statistic))).alias(name)
        for name, (column, statistic) in columns.items()
    ]
    return stats.groupBy("p_id").agg(*outputs)


def count_flags(df: DataFrame, columns: Sequence[str], total: str, binary: str) -> DataFrame:
    """Number of positive indicators and whether there is any."""
    counted = df.withColumn(total, reduce(lambda a, b: a + b, [F.col(name) for name in columns]))
    return counted.withColumn(binary, any_positive(total))


def star(base: DataFrame, *tables: DataFrame) -> DataFrame:
    """Left joins of one-row-per-participant tables onto ``base``; repeated columns are replaced."""
    result = base
    for table in tables:
        shared = [name for name in table.columns if name != "p_id" and name in result.columns]
        result = result.drop(*shared).join(table, "p_id", "left")
    return result


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing and total row count per column, from one aggregate row."""
    row = df.agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(name).isNull()).alias(name) for name in columns]
    )
    return row.unpivot("n_rows", list(columns), "column_name", "n_null").select("column_name", "n_null", "n_rows")


def number_records(df: DataFrame, key: str, ts: str, tie_break: Sequence[str], name: str = "record_num") -> DataFrame:
    """Add the zero-based record number per key in time order.

    Two levels: a running total over the key's days (as many rows as the study
    has days) plus the position within the day, so no task sorts all records of
    one key.
    """
    dated = df.withColumn("__day", F.to_date(ts))
    per_day = dated.groupBy(key, "__day").agg(F.count(F.lit(1)).alias("__n"))
    running = F.sum("__n").over(Window.partitionBy(key).orderBy("__day")) - F.col("__n")
    before = per_day.select(key, "__day", running.alias("__before"))
    inside = F.row_number().over(Window.partitionBy(key, "__day").orderBy(ts, *tie_break))
    numbered = null_safe_join(dated, before, [key, "__day"])
    return numbered.withColumn(name, F.col("__before") + inside - F.lit(1)).drop("__day", "__before")
