"""Align event streams with enrolment.

Raw event tables are the large input. Each operator first reduces them to one
row per participant, type and calendar day (``daily_rollup``), a hash aggregate
with map-side combine whose key includes the day. A participant who owns a
third of all records is thus spread over as many reducers as there are days,
and what reaches the per-participant joins is bounded by the study length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.functions.calendar import bin_of, day_in_study, week_from_zero
from cohortwise.functions.nulls import not_within, null_safe_join
from cohortwise.functions.spread import spread_join


def daily_rollup(events: DataFrame, keys: Sequence[str] = ("p_id", "data_name"), ts: str = "ts") -> DataFrame:
    """One row per key and calendar day: record count, first and last instant."""
    return events.groupBy(*keys, F.to_date(ts).alias("day")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
    )


def attach_enrollment(df: DataFrame, enrollment: DataFrame, spread_by: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Join of the enrolment date on ``p_id`` alone.

    Repeating it changes nothing: an enrolment date already present is replaced.
    Tables that are not reduced to days yet name columns in ``spread_by`` so that
    the records of one participant go to many tasks.
    """
    dates = enrollment.select("p_id", "enrollment_date")
    bare = df.drop("enrollment_date")
    return spread_join(bare, dates, ["p_id"], how, spread_by) if spread_by else bare.join(dates, "p_id", how)


def index_days(events: DataFrame, enrollment: DataFrame, ts: str = "ts", offset: int = 1) -> DataFrame:
    """Enrolled event rows with ``day_in_study``, both week conventions and the biweek."""
    day = F.to_date(ts)
    indexed = attach_enrollment(events, enrollment, [ts]).withColumn("day_in_study", day_in_study(day, "enrollment_date", offset))
    return indexed.withColumns(
        {
            "week_a": week_from_zero("day_in_study"),
            "week_b": bin_of("day_in_study", 7),
            "biweek": bin_of("day_in_study", 14),
        }
    )


def daily_activity(events: DataFrame, enrollment: DataFrame, horizon: int) -> DataFrame:
    """Record count per participant, type and day in study within 1..horizon."""
    days = attach_enrollment(daily_rollup(events), enrollment)
    return (
        days.withColumn("day_in_study", day_in_study("day", "enrollment_date"))
        .filter(F.col("day_in_study").between(1, horizon))
        .select("p_id", "data_name", "day_in_study", "n")
    )


def tag_streams(active: DataFrame, passive: DataFrame, passive_types: dict[str, str], active_types: Sequence[str] | None = None) -> DataFrame:
    """Union of the event tables as ``(p_id, stream, ts)``; other passive types are left out. An enrolment date that both tables carry stays."""
    chosen = active if active_types is None else active.filter(F.col("data_name").isin(list(active_types)))
    stream = None
    for name, data_name in passive_types.items():
        test = F.col("data_name") == data_name
        stream = F.when(test, F.lit(name)) if stream is None else stream.when(test, F.lit(name))
    dated = ["enrollment_date"] if "enrollment_date" in active.columns and "enrollment_date" in passive.columns else []
    return chosen.select("p_id", F.lit("active").alias("stream"), "ts", *dated).unionByName(
        passive.filter(F.col("data_name").isin(list(passive_types.values()))).select("p_id", stream.alias("stream"), "ts", *dated)
    )


def _last_until(bound: Column) -> Column:
    """Latest instant not after midnight of ``bound``, from daily first/last instants.

    On the bound day itself only a record at exactly midnight qualifies, and if
    there is one it is that day's first.
    """
    midnight = bound.cast("timestamp_ntz")
    return F.max(
        F.when(F.col("day") < bound, F.col("last_ts")).when(
            (F.col("day") == bound) & (F.col("first_ts") == midnight), F.col("first_ts")
        )
    )


def last_activity(stream_events: DataFrame, enrollment: DataFrame, horizon: int, grace: int) -> DataFrame:
    """Per participant and stream: last record inside the horizon and inside the grace window.

    Both windows and all streams come from one pass. Null means no record in the window.
    """
    days = attach_enrollment(daily_rollup(stream_events, ("p_id", "stream")), enrollment)
    return days.groupBy("p_id", "stream").agg(
        _last_until(F.date_add("enrollment_date", horizon)).alias("last_h"),
        _last_until(F.date_add("enrollment_date", grace)).alias("last_grace"),
    )


def last_activity_wide(stream_events: DataFrame, enrollment: DataFrame, streams: Sequence[str], horizon: int, grace: int) -> DataFrame:
    """The same, one row per participant with ``last_h_<stream>`` and ``last_grace_<stream>``.

    Partitioned by ``p_id`` on arrival, so a following join on ``p_id`` needs no shuffle.
    """
    days = attach_enrollment(daily_rollup(stream_events, ("p_id", "stream")), enrollment)
    columns = []
    for stream in streams:
        for label, width in (("last_h", horizon), ("last_grace", grace)):
            bound = F.when(F.col("stream") == stream, F.date_add("enrollment_date", width))
            columns.append(_last_until(bound).alias(f"{label}_{stream}"))
    return days.groupBy("p_id").agg(*columns)


def participant_dates(
    active: DataFrame, passive: DataFrame, clinical: DataFrame, enrollment: DataFrame, passive_types: dict[str, str]
) -> DataFrame:
    """First and last date per participant and source, with the enrolment date.

    Stands for a chain of full outer joins: the per-source rows are stacked and
    grouped once, which keeps ids that occur in any source, null included.
    """
    rows = None
    sources = [
        ("active", daily_rollup(active), "day"),
        ("passive", daily_rollup(passive), "day"),
        ("clin", clinical.select("p_id", "date"), "date"),
        ("enrol", enrollment.select("p_id", "enrollment_date"), "enrollment_date"),
    ]
    for source, df, day in sources:
        data_name = F.col("data_name") if source == "passive" else F.lit(None).cast("string")
        part = df.select("p_id", F.lit(source).alias("source"), data_name.alias("data_name"), F.col(day).alias("day"))
        rows = part if rows is None else rows.unionByName(part)

    def span(prefix: str, test: Column) -> list[Column]:
        value = F.when(test, F.col("day"))
        return [F.min(value).alias(f"{prefix}_first"), F.max(value).alias(f"{prefix}_last")]

    columns = span("active", F.col("source") == "active") + span("passive", F.col("source") == "passive")
    for name, data_name in passive_types.items():
        columns += span(name, F.col("data_name") == data_name)
    columns += span("clin", F.col("source") == "clin")
    columns.append(F.min(F.when(F.col("source") == "enrol", F.col("day"))).alias("enrollment_date"))
    return rows.groupBy("p_id").agg(*columns)


def drop_ids(df: DataFrame, ids: Sequence) -> DataFrame:
    """Remove a fixed list of ids; rows without an id stay."""
    return df.filter(not_within("p_id", ids))


def unenrolled_ids(dates: DataFrame, enrollment: DataFrame) -> DataFrame:
    """Ids that have data but no enrolment row; ids are made distinct before they are compared."""
    return remove_ids(dates.select("p_id").distinct(), enrollment)


def remove_ids(df: DataFrame, ids: DataFrame, spread_by: Sequence[str] = ()) -> DataFrame:
    """Rows whose id is not in ``ids`` (null equals null); ``spread_by`` as in ``attach_enrollment``."""
    if spread_by:
        return spread_join(df, ids.select("p_id"), ["p_id"], "left_anti", spread_by)
    return null_safe_join(df, ids.select("p_id"), ["p_id"], "left_anti")


def keep_ids(df: DataFrame, ids: DataFrame, spread_by: Sequence[str] = ()) -> DataFrame:
    """Rows whose id is in ``ids``."""
    if spread_by:
        return spread_join(df, ids.select("p_id"), ["p_id"], "left_semi", spread_by)
    return null_safe_join(df, ids.select("p_id"), ["p_id"], "left_semi")


def distinct_participants(stream_events: DataFrame) -> DataFrame:
    """Number of different ids per stream; a missing id counts as one."""
    ids = stream_events.groupBy("stream", "p_id").agg(F.lit(1).alias("one"))
    return ids.groupBy("stream").agg(F.count(F.lit(1)).alias("n_participants"))


def study_window(active: DataFrame, enrollment: DataFrame) -> DataFrame:
    """One row: first enrolment day and last day with active data of an enrolled participant."""
    last = active.groupBy("p_id").agg(F.to_date(F.max("ts")).alias("active_last"))
    return enrollment.join(last, "p_id", "left").agg(
        F.min("enrollment_date").alias("first_day"), F.max("active_last").alias("last_day")
    )


def days_in_study(active: DataFrame, enrollment: DataFrame) -> DataFrame:
    """Long form ``(p_id, type, value)``: days a participant could have stayed and did stay.

    The last study day is a one-row scalar subquery over the same per-participant
    aggregate, so the event table is read once.
    """
    last = active.groupBy("p_id").agg(F.to_date(F.max("ts")).alias("active_last"))
    people = enrollment.select("p_id", "enrollment_date").join(last, "p_id", "left")
    final_day = people.agg(F.max("active_last").alias("final_day"))
    days = people.select(
        "p_id",
        day_in_study(final_day.scalar(), "enrollment_date").alias("theoretical_max"),
        F.coalesce(day_in_study("active_last", "enrollment_date"), F.lit(1)).alias("actual_days"),
    )
    return days.unpivot("p_id", ["theoretical_max", "actual_days"], "type", "value")


def cohort_members(days: DataFrame, minimum: int) -> DataFrame:
    """Participants who could have been observed for at least ``minimum`` days."""
    return days.filter((F.col("type") == "theoretical_max") & (F.col("value") >= minimum)).select("p_id").distinct()
