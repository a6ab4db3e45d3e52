"""Engagement matrices of the three data streams and cluster profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.config import BIWEEK, PASSIVE_TYPES, STREAMS, SURVEY_TYPES, Cohort
from cohortwise.functions.calendar import bin_of, day_in_study
from cohortwise.operators import align, cluster, grid, summary


#: Streams whose profile takes the highest known baseline score; in the others a missing score makes it unknown.
KNOWN_BASELINE = ("phone",)


def bins_of(cohort: Cohort, stream: str) -> int:
    """Biweeks for the questionnaire stream, days for the passive streams."""
    return cohort.biweeks if stream == "active" else cohort.horizon


def _day_bins(events: DataFrame, enrollment: DataFrame, keys: tuple[str, ...], horizon: int) -> DataFrame:
    """Days in study (1..horizon) per key.

    Raw events are reduced to days before they meet the enrolment table. Events that carry the enrolment date are cut to the
    horizon where they are; a day may then come several times, which sets the same bit.
    """
    if "enrollment_date" in events.columns:
        days = events.withColumn("day", F.to_date("ts"))
    else:
        days = align.attach_enrollment(align.daily_rollup(events, keys).select(*keys, "day"), enrollment)
    indexed = days.withColumn("bin", day_in_study("day", "enrollment_date"))
    return indexed.filter(F.col("bin").between(1, horizon))


def stream_words(
    stream: str, active: DataFrame, passive: DataFrame, enrollment: DataFrame, participants: DataFrame, cohort: Cohort
) -> DataFrame:
    """Activity words of one stream for every participant."""
    if stream == "active":
        events = active.filter(F.col("data_name").isin(list(SURVEY_TYPES)))
    else:
        events = passive.filter(F.col("data_name") == PASSIVE_TYPES[stream])
    days = _day_bins(events, enrollment, ("p_id",), cohort.horizon)
    if stream == "active":
        days = days.withColumn("bin", bin_of("bin", BIWEEK))
    return grid.all_participants(grid.activity_words(days, bins_of(cohort, stream)), participants)


def all_stream_words(
    active: DataFrame, passive: DataFrame, enrollment: DataFrame, participants: DataFrame, cohort: Cohort
) -> DataFrame:
    """Activity words of the three streams side by side (``<stream>_w0``, ...), from one pass over the events."""
    events = align.tag_streams(active, passive, PASSIVE_TYPES, SURVEY_TYPES)
    days = _day_bins(events, enrollment, ("p_id", "stream"), cohort.horizon)
    packed = []
    for stream in STREAMS:
        bin_column = bin_of("bin", BIWEEK) if stream == "active" else F.col("bin")
        packed += grid.pack_bins(bin_column, bins_of(cohort, stream), F.col("stream") == stream, f"{stream}_w")
    return grid.all_participants(days.groupBy("p_id").agg(*packed), participants)


def by_stream(wide: DataFrame, cohort: Cohort, minimum: tuple[int, ...], keep: tuple[str, ...] = ("p_id",), with_bins: bool = False) -> DataFrame:
    """One row per participant and stream with cluster, engaged bins and engaged days, unfolded in place.

    A biweek counts for 14 days. ``with_bins`` adds the list of active bins.
    """
    cells = []
    for stream in STREAMS:
        bins = bins_of(cohort, stream)
        names = grid.word_names(bins, f"{stream}_w")
        engaged = grid.count_bits(names)
        fields = [
            F.lit(stream).alias("stream"),
            cluster.rule_label(engaged, minimum).alias("cluster"),
            engaged.alias("engaged"),
            (engaged * F.lit(BIWEEK if stream == "active" else 1)).alias("engaged_days"),
        ]
        if with_bins:
            fields += [F.lit(bins).alias("bins"), grid.active_bins(names, bins).alias("active")]
        cells.append(F.struct(*fields))
    return wide.select(*keep, F.inline(F.array(*cells)))


def stream_clusters(wide: DataFrame, cohort: Cohort, minimum: tuple[int, ...]) -> DataFrame:
    """One row per participant with the cluster in each stream side by side, in columns named like the streams."""
    labels = [cluster.rule_label(grid.count_bits(grid.word_names(bins_of(cohort, s), f"{s}_w")), minimum).alias(s) for s in STREAMS]
    return wide.select("p_id", *labels)


def survey_summary(indexed: DataFrame, kind: str, score_statistic: str, horizon: int, pinned: bool = False) -> DataFrame:
    """Score, response time (min) and completion time (s) per participant for one questionnaire.

    ``kind`` is ``phq8`` or ``rses``; ``indexed`` are its day-indexed records.
    """
    stats = summary.survey_period_summary(
        indexed,
        horizon,
        {
            f"mean_{kind}_score": (f"sum_{kind}", score_statistic),
            "lag_s": ("response_lag", "median"),
            f"{kind}_total_s": ("total_time_taken", "median"),
        },
        pinned,
    )
    return stats.withColumn(f"{kind}_response_min", F.col("lag_s") / F.lit(60.0)).drop("lag_s")


def survey_summaries(phq8: DataFrame, rses: DataFrame, cohort: Cohort) -> tuple[DataFrame, DataFrame]:
    """Both questionnaires as the cohort defines them."""
    return (
        survey_summary(phq8, "phq8", cohort.score_statistic, cohort.horizon),
        survey_summary(rses, "rses", "mean", cohort.horizon),
    )


def cluster_profile(
    clusters: DataFrame, demographics: DataFrame, contacts: DataFrame, visits: DataFrame, surveys: DataFrame, baseline: DataFrame
) -> DataFrame:
    """Membership with all per-participant summaries, each already partitioned by ``p_id``."""
    return summary.star(clusters, demographics, contacts, visits, surveys, baseline)
