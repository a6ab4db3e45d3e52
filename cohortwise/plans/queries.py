"""One query per operator over the benchmark tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortwise.config import COHORT_1, COHORT_2, PASSIVE_TYPES, STREAM_LABELS, STREAMS, Cohort
from cohortwise.functions import coding
from cohortwise.functions.calendar import bin_label
from cohortwise.functions.spread import spread_join
from cohortwise.operators import align, cluster, compare, concordance, cox, describe, grid, lloyd, medoids, patterns, ranks, report, summary, survival
from cohortwise.plans import engagement, retention
from cohortwise.plans.fixtures import Fixtures
from cohortwise.sources import study
from cohortwise.sources.durable import durable

# Parameters of the analyses on these tables.
DUMMY_IDS = (207, 209, 227)
SITES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
MARRY = {"HOUSEHOLD": "Married", "BUILDING": "Married", "MACHINERY": "Single", "AUTOMOBILE": "Single"}
RSES_LIMIT = 20
RULE_BINS = (3, 2, 1)
AGE_BREAKS = (18, 30, 40, 50, 60, 70, 80)
SUBDAY = {"horizon": 14, "grace": 21}
SEED = 3435435

QUERIES: dict[str, Callable[[Fixtures], DataFrame]] = {}


def query(build: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def present(df: DataFrame, digits: int = 6, exact: tuple[str, ...] = ()) -> DataFrame:
    """Whole numbers as bigint, other numbers rounded; for comparison and display."""
    columns = []
    for field in df.schema:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.IntegralType):
            value = value.cast("bigint")
        elif isinstance(field.dataType, (T.FractionalType, T.DecimalType)) and field.name not in exact:
            value = F.round(value.cast("double"), digits)
        columns.append(value.alias(field.name))
    return df.select(*columns)


# Shared inputs -----------------------------------------------------------------


def _star(f: Fixtures) -> DataFrame:
    illness = summary.count_flags(f.comorbidity(), study.ILLNESS_FLAGS, "comorb_sum", "comorb")
    people = f.demographics().select(
        "p_id", "age", "sex", "site", "marry_align", "edu_age_align",
        study.brand_label("brand_code").alias("phone_brand"),
        study.employment_label("employment_status").alias("employment"),
        F.when(F.col("phone_status") == 3, 0).otherwise(F.col("phone_status")).alias("phone_status"),
    )
    return summary.star(people, illness.select("p_id", "comorb_sum", "comorb"))


def _outside(f: Fixtures) -> DataFrame:
    return align.unenrolled_ids(f.active(), f.enrollment())


def _people(f: Fixtures) -> DataFrame:
    return align.remove_ids(_star(f), _outside(f))


def _participants(f: Fixtures) -> DataFrame:
    return align.remove_ids(f.demographics().select("p_id"), _outside(f))


def _scored(records: DataFrame) -> DataFrame:
    lag = F.nullif(F.col("notif_lag_s"), F.lit(summary.NO_NOTIFICATION))
    return summary.score_surveys(records.withColumn("response_lag", lag)).drop(*summary.RSES_ITEMS)


def _surveys(f: Fixtures) -> DataFrame:
    return _scored(f.survey())


def _indexed_surveys(f: Fixtures) -> DataFrame:
    return summary.index_dated(_scored(f.survey(f.enrollment())))


def _period_surveys(f: Fixtures, cohort: Cohort) -> DataFrame:
    """Survey records of the period and the baseline weeks, from one pass over the order lines."""
    columns = ["p_id", "days", "week", "sum_phq8", "sum_rses", "response_lag", "total_time_taken", "of_rses"]
    return summary.in_period(_indexed_surveys(f).select(*columns), cohort.horizon)


def _rses_summary(indexed: DataFrame, cohort: Cohort, pinned: bool = False) -> DataFrame:
    """Score, response time and completion time of the RSES questionnaire."""
    return engagement.survey_summary(indexed.filter("of_rses"), "rses", "mean", cohort.horizon, pinned)


def _survey_summary(indexed: DataFrame, cohort: Cohort, pinned: bool = False) -> DataFrame:
    stats = summary.survey_period_summary(
        indexed,
        cohort.horizon,
        {
            "mean_phq8_score": ("sum_phq8", cohort.score_statistic),
            "phq8_lag_s": ("response_lag", "median"),
            "phq8_total_s": ("total_time_taken", "median"),
            "mean_rses_score": ("sum_rses", "mean"),
        },
        pinned,
    )
    return stats.withColumn("phq8_response_min", F.col("phq8_lag_s") / F.lit(60.0)).drop("phq8_lag_s")


def _days_in_study(f: Fixtures) -> DataFrame:
    return align.days_in_study(f.active(), f.enrollment())


def _members(f: Fixtures, cohort: Cohort) -> DataFrame:
    return align.cohort_members(_days_in_study(f), cohort.horizon)


def _words(f: Fixtures, stream: str, cohort: Cohort = COHORT_1) -> DataFrame:
    participants = _participants(f)
    if cohort.members_only:
        participants = align.keep_ids(participants, _members(f, cohort))
    enrollment = f.enrollment()
    if cohort.members_only:
        enrollment = align.keep_ids(enrollment, _members(f, cohort))
    return engagement.stream_words(stream, f.active(), f.passive(), enrollment, participants, cohort)


def _wide_words(f: Fixtures, cohort: Cohort = COHORT_1) -> DataFrame:
    participants, enrollment = _participants(f), f.enrollment()
    if cohort.members_only:
        members = durable(_members(f, cohort))
        participants, enrollment = align.keep_ids(participants, members), align.keep_ids(enrollment, members)
    return engagement.all_stream_words(f.active(enrollment), f.passive(enrollment), enrollment, participants, cohort)


def _labels(f: Fixtures, cohort: Cohort, base: DataFrame | None = None) -> DataFrame:
    enrollment = f.enrollment()
    start = enrollment.select("p_id", "enrollment_date") if base is None else base
    if cohort.members_only:
        start = align.keep_ids(start, _members(f, cohort))
    return retention.dropout_labels(f.active(), f.passive(), enrollment, start, cohort)


def _long_labels(f: Fixtures, cohort: Cohort = COHORT_1) -> DataFrame:
    return survival.dropout_long(_labels(f, cohort), STREAMS)


def _baseline(f: Fixtures) -> DataFrame:
    return summary.baseline_first(_surveys(f), "sum_phq8", ("total_time_taken",))


def _cohort_table(f: Fixtures, cohort: Cohort = COHORT_1) -> DataFrame:
    people = _people(f)
    if cohort.members_only:
        people = align.keep_ids(people, _members(f, cohort))
    base = people.select("p_id").join(f.enrollment().select("p_id", "enrollment_date"), "p_id", "left")
    labels = _labels(f, cohort, base)
    contacts = summary.contact_count(f.contacts(), f.enrollment(), cohort.horizon) if cohort.with_contacts else None
    table = retention.survival_cohort(people, f.enrollment(), labels, contacts, _baseline(f))
    return retention.model_covariates(table.withColumn("marry_align", coding.recode("marry_align", MARRY)))


def _profiles(f: Fixtures, wide: DataFrame | None = None) -> DataFrame:
    """One row per participant and stream with the cluster in that stream and all per-participant summaries, from one pass over the events."""
    indexed = _period_surveys(f, COHORT_1)
    shared = summary.star(
        _wide_words(f) if wide is None else wide,
        _people(f),
        summary.contact_count(f.contacts(), f.enrollment(), COHORT_1.horizon),
        summary.visit_summary(f.visits(), f.enrollment(), COHORT_1.horizon),
        _survey_summary(indexed, COHORT_1, pinned=True),
        summary.baseline_max(indexed, "sum_phq8").select("p_id", "sum_phq8"),
        summary.baseline_top1(indexed, "sum_phq8").select("p_id", F.col("sum_phq8").alias("known_phq8")),
    )
    own = [c for c in (*PROFILE_NUMBERS, *PROFILE_FACTORS) if c != "engaged"]
    rows = engagement.by_stream(shared, COHORT_1, RULE_BINS, ("p_id", *own, "known_phq8"))
    known = F.col("stream").isin(*engagement.KNOWN_BASELINE)
    return rows.withColumn("sum_phq8", F.when(known, F.col("known_phq8")).otherwise(F.col("sum_phq8"))).drop("known_phq8")


def _marked(long: DataFrame, name: str = "variable") -> DataFrame:
    """The stream as part of ``name``, for operators that keep apart by one column."""
    return long.withColumn(name, F.concat_ws("/", "stream", name)).drop("stream")


def _unmarked(table: DataFrame, name: str = "variable") -> DataFrame:
    return table.withColumns({"stream": F.substring_index(name, "/", 1), name: F.substring_index(name, "/", -1)})


def _fit(f: Fixtures, table: DataFrame | None = None) -> cox.CoxFit:
    table = _cohort_table(f) if table is None else table
    terms = retention.model_terms(table.columns, SITES)
    return cox.coxph(retention.long_matrix(table, terms), terms, model="stream")


# Cleaning and alignment ----------------------------------------------------------


@query
def enrollment_dim(f: Fixtures) -> DataFrame:
    return present(study.enrollment_dim(f.enrollment()))


@query
def participant_dates(f: Fixtures) -> DataFrame:
    return present(align.participant_dates(f.active(), f.passive(), f.visit_dates(), f.enrollment(), PASSIVE_TYPES))


@query
def drop_dummy_ids(f: Fixtures) -> DataFrame:
    return present(align.drop_ids(f.active(), DUMMY_IDS).groupBy("p_id").agg(F.count(F.lit(1)).alias("n")))


@query
def unenrolled_ids(f: Fixtures) -> DataFrame:
    return present(_outside(f))


@query
def unenrolled_removed(f: Fixtures) -> DataFrame:
    counts = f.active().groupBy("p_id").agg(F.count(F.lit(1)).alias("n"))
    return present(align.remove_ids(counts, _outside(f)))


@query
def distinct_participants(f: Fixtures) -> DataFrame:
    tagged = f.active().select(F.lit("active").alias("stream"), "p_id").unionByName(
        f.passive().select(F.lit("passive").alias("stream"), "p_id")
    )
    return present(align.distinct_participants(tagged))


@query
def study_window(f: Fixtures) -> DataFrame:
    return present(align.study_window(f.active(), f.enrollment()))


@query
def day_index(f: Fixtures) -> DataFrame:
    indexed = align.index_days(f.passive(), f.enrollment())
    return present(indexed.select("p_id", "ts", "day_in_study", "week_a", "week_b", "biweek"))


@query
def daily_activity(f: Fixtures) -> DataFrame:
    return present(align.daily_activity(f.passive(), f.enrollment(), COHORT_1.horizon))


@query
def daily_activity_subday(f: Fixtures) -> DataFrame:
    return present(align.daily_activity(f.event_stream(), f.event_enrollment(), SUBDAY["horizon"]))


def _last_activity(f: Fixtures, cohort: Cohort) -> DataFrame:
    events = align.tag_streams(f.active(), f.passive(), PASSIVE_TYPES)
    return present(align.last_activity(events, f.enrollment(), cohort.horizon, cohort.grace))


@query
def last_activity(f: Fixtures) -> DataFrame:
    return _last_activity(f, COHORT_1)


@query
def last_activity_cohort_2(f: Fixtures) -> DataFrame:
    return _last_activity(f, COHORT_2)


@query
def last_activity_subday(f: Fixtures) -> DataFrame:
    events = f.event_stream().withColumnRenamed("data_name", "stream")
    return present(align.last_activity(events, f.event_enrollment(), **SUBDAY))


@query
def dropout_labels(f: Fixtures) -> DataFrame:
    return present(_long_labels(f))


@query
def dropout_labels_cohort_2(f: Fixtures) -> DataFrame:
    return present(_long_labels(f, COHORT_2))


@query
def recode_lookup(f: Fixtures) -> DataFrame:
    employment = study.employment_label("employment_status")
    marry = coding.recode("marry_align", MARRY)
    return present(
        f.demographics().select(
            "p_id",
            study.brand_label("brand_code").alias("brand"),
            employment.alias("employment"),
            coding.keep_listed(employment, retention.YES_NO).alias("employment_cat"),
            coding.flag("phone_status", 1).alias("phone_status_cat"),
            coding.keep_listed(marry, retention.MARRY_LEVELS).alias("marry_cat"),
        )
    )


@query
def threshold_bands(f: Fixtures) -> DataFrame:
    people = summary.star(f.demographics(), _baseline(f))
    return present(
        people.select(
            "p_id",
            coding.upper_bands("age", retention.AGE_EDGES, retention.AGE_BEYOND).alias("age_band"),
            coding.upper_bands("age", retention.AGE_EDGES, retention.AGE_BEYOND, True).alias("age_band_compat"),
            coding.lower_bands("sum_phq8", retention.PHQ_EDGES).alias("phq_band"),
            coding.cap("brand_code", 3).alias("items_capped"),
        )
    )


@query
def survey_scores(f: Fixtures) -> DataFrame:
    scored = _surveys(f)
    return present(scored.select("p_id", "start_time", "sum_phq8", coding.drop_above("sum_rses", RSES_LIMIT).alias("sum_rses")))


@query
def survey_response_lag(f: Fixtures) -> DataFrame:
    cleaned = summary.clean_notifications(f.notifications())
    return present(
        cleaned.select("p_id", "start_time", (F.col("response_lag") / F.lit(60.0)).alias("response_lag_min"), "total_time_taken")
    )


@query
def demographics_star(f: Fixtures) -> DataFrame:
    return present(
        _people(f).select(
            "p_id", "age", "sex", "site", F.col("phone_brand").alias("brand"), "employment", "comorb_sum", "comorb", "phone_status"
        )
    )


@query
def null_profile(f: Fixtures) -> DataFrame:
    columns = ["p_id", "age", "sex", "site", "phone_brand", "employment", "comorb_sum", "comorb", "phone_status", "enrollment_date", "withdrawal_date"]
    return present(summary.null_profile(summary.star(_people(f), f.enrollment()), columns))


# Summaries -------------------------------------------------------------------------


@query
def contact_count(f: Fixtures) -> DataFrame:
    return present(summary.contact_count(f.contacts(), f.enrollment(), COHORT_1.horizon))


@query
def baseline_first(f: Fixtures) -> DataFrame:
    return present(_baseline(f))


@query
def baseline_max(f: Fixtures) -> DataFrame:
    return present(summary.baseline_max(_indexed_surveys(f), "sum_phq8", "sum_rses"))


@query
def baseline_top1(f: Fixtures) -> DataFrame:
    return present(summary.baseline_top1(_indexed_surveys(f), "sum_phq8", ["total_time_taken"], order=["total_time_taken"]))


@query
def ids_in_period(f: Fixtures) -> DataFrame:
    return present(summary.visit_summary(f.visits(), f.enrollment(), COHORT_1.horizon))


@query
def survey_period_summary(f: Fixtures) -> DataFrame:
    stats = summary.survey_period_summary(
        _indexed_surveys(f),
        COHORT_1.horizon,
        {
            "mean_phq8_score": ("sum_phq8", "mean"),
            "median_phq8_score": ("sum_phq8", "median"),
            "phq8_lag_s": ("response_lag", "median"),
            "phq8_total_s": ("total_time_taken", "median"),
            "mean_rses_score": ("sum_rses", "mean"),
        },
    )
    return present(stats.withColumn("phq8_response_min", F.col("phq8_lag_s") / F.lit(60.0)).drop("phq8_lag_s"))


@query
def survey_period_summary_cohort_2(f: Fixtures) -> DataFrame:
    return present(_survey_summary(_indexed_surveys(f), COHORT_2))


@query
def rses_period_summary(f: Fixtures) -> DataFrame:
    return present(_rses_summary(_indexed_surveys(f), COHORT_1))


@query
def days_in_study(f: Fixtures) -> DataFrame:
    return present(_days_in_study(f))


@query
def cohort_members(f: Fixtures) -> DataFrame:
    days = _days_in_study(f)
    lists = [align.cohort_members(days, c.horizon).select(F.lit(c.name).alias("cohort"), "p_id") for c in (COHORT_1, COHORT_2)]
    return present(lists[0].unionByName(lists[1]))


@query
def quantile_grid(f: Fixtures) -> DataFrame:
    return present(describe.quantile_grid(_days_in_study(f), "type", 0.02))


@query
def quantile_compare(f: Fixtures) -> DataFrame:
    return present(describe.quantile_grid(_days_in_study(f), "type", 0.05))


# Engagement matrices and clusters ---------------------------------------------------


@query
def activity_grid_biweek(f: Fixtures) -> DataFrame:
    return present(grid.activity_grid(_words(f, "active"), COHORT_1.biweeks))


@query
def activity_grid_daily(f: Fixtures) -> DataFrame:
    """Days of both passive streams, from one pass over the events."""
    wide = _wide_words(f)
    cells = []
    for stream in ("phone", "fitbit"):
        words = zip(grid.word_names(COHORT_1.horizon, f"{stream}_w"), grid.word_names(COHORT_1.horizon))
        cells.append(F.struct(F.lit(stream).alias("stream"), *[F.col(theirs).alias(plain) for theirs, plain in words]))
    return present(grid.activity_grid(wide.select("p_id", F.inline(F.array(*cells))), COHORT_1.horizon, ("p_id", "stream")))


def _activity_vector(f: Fixtures, cohort: Cohort) -> DataFrame:
    vector = grid.activity_vector(grid.word_names(cohort.biweeks), cohort.biweeks)
    return present(_words(f, "active", cohort).select("p_id", F.array_join(vector.cast("array<string>"), "").alias("vec")))


@query
def activity_vector(f: Fixtures) -> DataFrame:
    return _activity_vector(f, COHORT_1)


@query
def activity_vector_cohort_2(f: Fixtures) -> DataFrame:
    return _activity_vector(f, COHORT_2)


@query
def activity_pivot(f: Fixtures) -> DataFrame:
    return present(grid.activity_wide(_words(f, "active"), COHORT_1.biweeks))


@query
def engagement_counts(f: Fixtures) -> DataFrame:
    rows = engagement.by_stream(_wide_words(f), COHORT_1, RULE_BINS)
    return present(rows.select("p_id", "stream", F.col("engaged").alias("engaged_bins"), "engaged_days"))


@query
def bin_labels(f: Fixtures) -> DataFrame:
    days = align.daily_activity(f.passive().filter(F.col("data_name") == PASSIVE_TYPES["phone"]), f.enrollment(), COHORT_1.horizon)
    counted = days.groupBy((F.col("day_in_study") - 1).alias("bin")).agg(F.count(F.lit(1)).alias("n_active"))
    return present(counted.select("bin", bin_label("bin").alias("label"), "n_active"))


@query
def cluster_profile(f: Fixtures) -> DataFrame:
    return present(
        _profiles(f).select(
            "stream", "p_id", "cluster", "age", "sex", "site", "engaged", "num_contact", "count_ids", "baseline_ids", "mean_phq8_score",
            "phq8_response_min", "phq8_total_s", "mean_rses_score", F.col("sum_phq8").alias("baseline_phq8"),
        )
    )


@query
def cluster_bin_rate(f: Fixtures) -> DataFrame:
    members = engagement.by_stream(_wide_words(f), COHORT_1, RULE_BINS, with_bins=True)
    return present(cluster.bin_rate(members, ["stream", "cluster"]))


@query
def cluster_membership(f: Fixtures) -> DataFrame:
    """Participants in display order, by cluster and id, for each stream."""
    members = engagement.by_stream(_wide_words(f), COHORT_1, RULE_BINS).select("stream", "p_id", "cluster")
    return present(cluster.ordered_membership(members, tuple(f"C{k + 1}" for k in range(len(RULE_BINS) + 1)), ["stream"]))


def _records(f: Fixtures) -> list[tuple[DataFrame, list[str], list[str]]]:
    """Survey and visit records with the columns to count and those that tell the records of a participant apart."""
    surveys = _surveys(f).select(
        "p_id", "start_time", "sum_phq8", coding.drop_above("sum_rses", RSES_LIMIT).alias("sum_rses"),
        (F.col("response_lag") / F.lit(60.0)).alias("response_lag_min"), "total_time_taken",
    )
    visits = summary.visits_in_period(f.visits(), f.enrollment(), COHORT_1.horizon).select("p_id", "date", "record_num", "ids_score")
    return [
        (surveys, ["sum_phq8", "sum_rses", "response_lag_min", "total_time_taken"], ["start_time", "total_time_taken"]),
        (visits, ["ids_score"], ["date", "record_num"]),
    ]


def _longitudinal_counts(f: Fixtures, wide: DataFrame) -> DataFrame:
    """Value counts of the records of each cluster, the stream as part of the variable.

    Records meet the clusters of their participant as they are, spread over many tasks, and are folded to counts per combination of
    clusters right there; streams are unfolded from the counts.
    """
    members = engagement.stream_clusters(wide, COHORT_1, RULE_BINS)
    counts = None
    for records, columns, spread_by in _records(f):
        joined = spread_join(records, members, ["p_id"], "inner", spread_by)
        part = ranks.value_counts(describe.melt(joined, STREAMS, columns), [*STREAMS, "variable"])
        counts = part if counts is None else counts.unionByName(part)
    each = F.inline(F.array(*[F.struct(F.lit(s).alias("stream"), F.col(s).alias("stratum")) for s in STREAMS]))
    return _marked(counts.select("variable", "value", "n", each)).groupBy("variable", "stratum", "value").agg(F.sum("n").alias("n"))


@query
def longitudinal_by_group(f: Fixtures) -> DataFrame:
    table = _unmarked(compare.quantile_table(durable(_longitudinal_counts(f, durable(_wide_words(f))))))
    return present(table.select("stream", F.col("stratum").alias("cluster"), "variable", "n", "n_missing", "q1", "median", "q3"))


def _streams(f: Fixtures) -> DataFrame:
    indexed = _period_surveys(f, COHORT_1)
    shared = ("age", "mean_phq8_score", "phq8_response_min", "phq8_total_s", "rses_total_s", "sum_phq8", "known_phq8")
    people = summary.star(
        _wide_words(f), _people(f).select("p_id", "age"), _survey_summary(indexed, COHORT_1, pinned=True), _rses_summary(indexed, COHORT_1, pinned=True).select("p_id", "rses_total_s"),
        summary.baseline_max(indexed, "sum_phq8"), summary.baseline_top1(indexed, "sum_phq8").withColumnRenamed("sum_phq8", "known_phq8"),
    )
    rows = engagement.by_stream(people, COHORT_1, RULE_BINS, ("p_id", *shared))
    return rows.withColumns(
        {
            "cat": coding.recode("stream", STREAM_LABELS),
            "total_time": F.col("phq8_total_s") + F.col("rses_total_s"),
            "sum_phq8": F.when(F.col("stream").isin(*engagement.KNOWN_BASELINE), F.col("known_phq8")).otherwise(F.col("sum_phq8")),
        }
    ).drop("stream", "engaged", "rses_total_s", "known_phq8")


@query
def cluster_union_streams(f: Fixtures) -> DataFrame:
    return present(_streams(f).withColumnRenamed("sum_phq8", "baseline_phq8"))


@query
def cluster_extremes(f: Fixtures) -> DataFrame:
    rows = engagement.by_stream(_wide_words(f), COHORT_1, RULE_BINS).filter(F.col("cluster").isin("C1", "C4"))
    return present(rows.select("p_id", F.concat_ws("_", "cluster", "stream").alias("cluster"), "engaged"))


def _bins(cohort: Cohort) -> dict[str, int]:
    return {s: engagement.bins_of(cohort, s) for s in STREAMS}


def _stream_rows(f: Fixtures, cohort: Cohort = COHORT_1) -> DataFrame:
    return durable(patterns.stream_rows(_wide_words(f, cohort), _bins(cohort)))


@query
def wss_curve(f: Fixtures) -> DataFrame:
    """Elbow curve of k-means for every stream, all fits in one pass a step."""
    weighted = patterns.weighted_patterns(_stream_rows(f))
    return present(lloyd.curve(weighted, lloyd.fit_all(weighted, _bins(COHORT_1), range(1, 11), seed=SEED)).select("stream", "k", "wss"))


def _kmeans(f: Fixtures, cohort: Cohort) -> DataFrame:
    rows, bins = _stream_rows(f, cohort), _bins(cohort)
    fits = lloyd.fit_all(patterns.weighted_patterns(rows), bins, [cohort.clusters], seed=SEED)
    return lloyd.assign(rows, {fit.stream: fit for fit in fits}, bins)


@query
def kmeans_assign(f: Fixtures) -> DataFrame:
    return present(_kmeans(f, COHORT_1).select("stream", "p_id", "raw_cluster"))


@query
def cluster_labels(f: Fixtures) -> DataFrame:
    return present(_kmeans(f, COHORT_1).select("stream", "p_id", "cluster"))


@query
def cluster_labels_cohort_2(f: Fixtures) -> DataFrame:
    return present(_kmeans(f, COHORT_2).select("stream", "p_id", "cluster"))


def _from_rules(f: Fixtures) -> tuple[DataFrame, dict[str, lloyd.Fit]]:
    """k-means of every stream that starts from the means of the rule clusters."""
    bins = _bins(COHORT_1)
    wide = durable(_wide_words(f))
    rates = cluster.bin_rate(engagement.by_stream(wide, COHORT_1, RULE_BINS, with_bins=True), ["stream", "cluster"])
    found = {(r.stream, r.cluster, r.bin): r.active_rate for r in rates.collect()}  # streams x clusters x bins
    names = {s: sorted({c for t, c, _ in found if t == s}) for s in STREAMS}
    centers = {s: np.array([[found[s, c, b + 1] for b in range(bins[s])] for c in names[s]]) for s in STREAMS if names[s]}
    rows = durable(patterns.stream_rows(wide, bins))
    return rows, {fit.stream: fit for fit in lloyd.fit_all(patterns.weighted_patterns(rows), bins, [], centers=centers)}


@query
def kmeans_from_rules(f: Fixtures) -> DataFrame:
    rows, fits = _from_rules(f)
    return present(lloyd.assign(rows, fits, _bins(COHORT_1)).select("stream", "p_id", "raw_cluster"))


@query
def kmeans_from_rules_wss(f: Fixtures) -> DataFrame:
    rows, fits = _from_rules(f)
    return present(lloyd.curve(rows, list(fits.values())).select("stream", "k", "wss"))


@query
def medoid_curve(f: Fixtures) -> DataFrame:
    """Elbow curve of the clusters around medoids for every stream."""
    weighted = patterns.weighted_patterns(_stream_rows(f))
    return present(medoids.curve(weighted, medoids.fit_medoids(weighted, _bins(COHORT_1), 10)).drop("swaps"))


@query
def medoid_single(f: Fixtures) -> DataFrame:
    """The most central pattern of every stream."""
    weighted, bins = patterns.weighted_patterns(_stream_rows(f)), _bins(COHORT_1)
    fits = medoids.fit_medoids(weighted, bins, 1)
    return present(medoids.medoid_table(weighted, fits, bins).join(medoids.curve(weighted, fits).select("stream", "k", "cost", "wss"), ["stream", "k"]))


@query
def medoid_pair_cost(f: Fixtures) -> DataFrame:
    """Cost of the best two medoids of the questionnaire stream."""
    rows = patterns.stream_rows(_wide_words(f), {"active": COHORT_1.biweeks})
    weighted = patterns.weighted_patterns(rows)
    fits = medoids.fit_medoids(weighted, {"active": COHORT_1.biweeks}, 2)
    return present(medoids.curve(weighted, fits).select("stream", "k", "cost"))


# Group comparison --------------------------------------------------------------------

PROFILE_NUMBERS = ["age", "engaged", "num_contact", "count_ids", "baseline_ids", "mean_phq8_score", "phq8_response_min", "phq8_total_s", "mean_rses_score", "sum_phq8"]
PROFILE_FACTORS = ["sex", "site", "employment", "phone_brand", "phone_status", "comorb", "marry_align"]


def _profile_counts(profiles: DataFrame) -> DataFrame:
    """Value counts of the profile numbers of each cluster, the stream as part of the variable."""
    long = describe.melt(profiles.withColumnRenamed("cluster", "stratum"), ["stream", "stratum"], PROFILE_NUMBERS)
    return ranks.value_counts(_marked(long), ["variable", "stratum"])


def _profile_categories(profiles: DataFrame) -> DataFrame:
    return _unmarked(compare.table_one_categorical(_marked(profiles, "cluster"), PROFILE_FACTORS, "cluster"), "stratum")


@query
def table_one_continuous(f: Fixtures) -> DataFrame:
    return present(_unmarked(compare.quantile_table(durable(_profile_counts(_profiles(f))))))


@query
def table_one_categorical(f: Fixtures) -> DataFrame:
    return present(_profile_categories(engagement.by_stream(summary.star(_wide_words(f), _people(f)), COHORT_1, RULE_BINS, ("p_id", *PROFILE_FACTORS))))


@query
def table_one_site(f: Fixtures) -> DataFrame:
    return present(compare.table_one_continuous(_people(f), ["age", "edu_age_align", "comorb_sum"], "site"))


@query
def table_one_overall(f: Fixtures) -> DataFrame:
    return present(compare.table_one_categorical(_people(f), PROFILE_FACTORS, None))


@query
def kruskal_wallis(f: Fixtures) -> DataFrame:
    coded = compare.code_levels(_people(f), {"sex": ("female", "male"), "employment": ("No", "Not reported", "Yes")})
    return present(compare.kruskal_wallis(coded, ["age", "edu_age_align", "comorb_sum", "phone_status", "sex", "employment"], "site"))


@query
def chi_square(f: Fixtures) -> DataFrame:
    people = _people(f).select(
        coding.upper_bands("age", retention.AGE_EDGES, retention.AGE_BEYOND).alias("age_band"),
        coding.keep_listed("employment", retention.YES_NO).alias("employment_cat"),
    )
    return present(compare.chi_square(compare.contingency(people, "age_band", "employment_cat"), [], "age_band", "employment_cat"))


@query
def chi_square_two_by_two(f: Fixtures) -> DataFrame:
    cells = compare.contingency(_people(f), "sex", "comorb")
    return present(compare.chi_square(cells, [], "sex", "comorb", with_p=False))


@query
def histogram_counts(f: Fixtures) -> DataFrame:
    return present(describe.histogram_counts(f.demographics(), "age", AGE_BREAKS))


@query
def density_grid(f: Fixtures) -> DataFrame:
    density = describe.density_grid(_days_in_study(f), "type")
    return present(density, 9)


@query
def boxplot_by_group(f: Fixtures) -> DataFrame:
    values = ["age", "sum_phq8", "phq8_response_min", "phq8_total_s"]
    long = describe.melt(_streams(f), ["cat", "cluster"], values)
    return present(describe.boxplot_stats(long, ["variable", "cat", "cluster"], bucket_by="variable"))


@query
def whisker_limits(f: Fixtures) -> DataFrame:
    long = describe.melt(_streams(f), [], ["phq8_response_min", "phq8_total_s"])
    limits = describe.whisker_limits(long, ["variable"], bucket_by="variable")
    low = F.col("lo") * F.when(F.col("variable") == "phq8_response_min", 0.0).otherwise(1.0)
    return present(limits.select("variable", low.alias("lo"), (F.col("hi") * F.lit(1.1)).alias("hi")))


@query
def level_frequency(f: Fixtures) -> DataFrame:
    people = f.demographics().withColumn("employment", study.employment_label("employment_status"))
    return present(describe.level_frequency(people, ["sex", "marry_align", "employment", "phone_status"]))


@query
def demographic_summary(f: Fixtures) -> DataFrame:
    return present(describe.demographic_summary(f.demographics()))


@query
def numeric_summary(f: Fixtures) -> DataFrame:
    return present(describe.numeric_summary(f.demographics(), ["age", "edu_age_align"]))


@query
def comparison_report(f: Fixtures) -> DataFrame:
    """The cluster comparison of every stream as one stacked text table."""
    wide = durable(_wide_words(f))
    profiles = durable(_profiles(f, wide))
    names = {f"{s}/{old}": f"{s}/{new}" for s in STREAMS for old, new in {"sum_phq8": "record_phq8", "sum_rses": "record_rses", "ids_score": "record_ids"}.items()}
    records = _longitudinal_counts(f, wide).withColumn("variable", coding.recode("variable", names))
    counts = durable(_profile_counts(profiles).unionByName(records))
    numbers = _unmarked(compare.quantile_table(counts))
    tests = _unmarked(compare.kruskal_from_counts(counts.filter(F.col("value").isNotNull()), "stratum")).select("stream", "variable", "p")
    categories = _profile_categories(profiles)
    level_tests = compare.chi_square(categories, ["stream", "variable"], "level", "stratum").select("stream", "variable", "p")
    sections = [
        ("participants", ["age", *PROFILE_FACTORS, "num_contact", "engaged"]),
        ("depression", ["sum_phq8", "mean_phq8_score", "record_phq8", "response_lag_min", "total_time_taken"]),
        ("self-esteem", ["mean_rses_score", "record_rses"]),
        ("clinical", ["baseline_ids", "count_ids", "record_ids"]),
    ]
    return present(compare.comparison_report(numbers, categories, tests.unionByName(level_tests), sections, ["stream"]))


# Survival ------------------------------------------------------------------------------


@query
def survival_cohort(f: Fixtures) -> DataFrame:
    labels = [f"{kind}_{s}" for s in STREAMS for kind in ("duration", "event")]
    columns = ["p_id", "age_band", "sex", "marry_cat", "employment_cat", "edu_age_align", "phq_base", "phq_band", "comorb", "site", "phone_brand", "phone_status_cat", "num_contact", *labels]
    return present(_cohort_table(f).select(*columns))


@query
def km_curve(f: Fixtures) -> DataFrame:
    return present(survival.km_curve(_long_labels(f)))


@query
def km_curve_cohort_2(f: Fixtures) -> DataFrame:
    return present(survival.km_curve(_long_labels(f, COHORT_2)))


@query
def km_curve_by_sex(f: Fixtures) -> DataFrame:
    wide = summary.star(_labels(f, COHORT_1), f.demographics().select("p_id", "sex"))
    long = survival.dropout_long(wide, STREAMS, ("p_id", "sex"))
    return present(survival.km_curve(long, ("stream", "sex")))


@query
def km_confidence(f: Fixtures) -> DataFrame:
    return present(survival.km_confidence(survival.km_curve(_long_labels(f))).select("stream", "time", "surv", "se", "lower", "upper"))


@query
def km_median(f: Fixtures) -> DataFrame:
    return present(survival.km_median(survival.km_curve(_long_labels(f))))


@query
def km_curve_subday(f: Fixtures) -> DataFrame:
    events = f.event_stream().select("p_id", F.lit("app").alias("stream"), "ts")
    last = align.last_activity_wide(events, f.event_enrollment(), ["app"], **SUBDAY)
    wide = survival.dropout_wide(f.event_enrollment(), last, ["app"], SUBDAY["horizon"])
    return present(survival.km_curve(survival.dropout_long(wide, ["app"])))


def _split(f: Fixtures, cohort: Cohort, stream: str) -> DataFrame:
    labels = _long_labels(f, cohort).filter(F.col("stream") == stream).drop("stream")
    return present(survival.episode_split(labels, cohort.episodes[stream][0]))


@query
def episode_split(f: Fixtures) -> DataFrame:
    return _split(f, COHORT_1, "phone")


@query
def episode_split_cohort_2(f: Fixtures) -> DataFrame:
    return _split(f, COHORT_2, "active")


@query
def design_matrix(f: Fixtures) -> DataFrame:
    table = _cohort_table(f)
    terms = retention.model_terms(table.columns, SITES)
    matrix = survival.design_matrix(table, terms, ["p_id"])
    return present(survival.design_columns(matrix, len(survival.term_names(terms)), ["p_id"]))


@query
def cox_coefficients(f: Fixtures) -> DataFrame:
    return present(_fit(f).coefficients().withColumnRenamed("model", "stream"))


def _sex_model(f: Fixtures) -> cox.CoxFit:
    terms = [survival.Factor("sex", ("female", "male"))]
    return cox.coxph(retention.long_matrix(_cohort_table(f), terms), terms, model="stream", tolerance=1e-12)


@query
def cox_one_covariate(f: Fixtures) -> DataFrame:
    fit = _sex_model(f)
    joined = fit.coefficients().join(fit.summary().select("model", "n", "n_event", "loglik_null", "loglik"), "model")
    return present(joined.select(F.col("model").alias("stream"), "n", "n_event", "coef", "hr", "se", "z", "loglik_null", "loglik"), 5)


@query
def zph_one_covariate(f: Fixtures) -> DataFrame:
    tests = _sex_model(f).ph_test().filter(F.col("term") == "GLOBAL")
    return present(tests.select(F.col("model").alias("stream"), "chisq", "df"), 5)


def _episode_sex_model(f: Fixtures) -> cox.CoxFit:
    cuts = COHORT_1.episodes["phone"][0]
    terms = [survival.ByStratum(survival.Factor("sex", ("male", "female")), "tgroup", tuple(range(1, len(cuts) + 2)))]
    table = _cohort_table(f).withColumnsRenamed({"duration_phone": "duration", "event_phone": "event"})
    matrix = survival.design_matrix(survival.episode_split(table, cuts), terms, ["p_id", "tgroup", "tstop", "event"])
    return cox.coxph(matrix, terms, stratum="tgroup", time="tstop", tolerance=1e-12)


@query
def cox_episode_effect(f: Fixtures) -> DataFrame:
    return present(_episode_sex_model(f).coefficients().filter(F.col("coef").isNotNull()).select("term", "coef", "se"), 5)


@query
def cox_summary(f: Fixtures) -> DataFrame:
    fit = _fit(f)
    joined = fit.summary().join(fit.concordance(), "model").drop("converged", "steps")
    return present(joined.withColumnRenamed("model", "stream"))


def _stratified(f: Fixtures, cohort: Cohort, stream: str) -> DataFrame:
    fit = retention.episode_model(_cohort_table(f, cohort), cohort, stream, SITES)
    return present(fit.coefficients().withColumn("model", F.lit(stream)).withColumnRenamed("model", "stream"))


@query
def cox_stratified(f: Fixtures) -> DataFrame:
    return _stratified(f, COHORT_1, "phone")


@query
def cox_stratified_cohort_2(f: Fixtures) -> DataFrame:
    return _stratified(f, COHORT_2, "active")


@query
def hr_report(f: Fixtures) -> DataFrame:
    return report.hazard_ratio_report(_fit(f).coefficients()).withColumnRenamed("model", "stream")


@query
def forest_table(f: Fixtures) -> DataFrame:
    return present(_fit(f).forest().withColumnRenamed("model", "stream"))


@query
def schoenfeld_residuals(f: Fixtures) -> DataFrame:
    return present(_fit(f).schoenfeld().drop("stratum").withColumnRenamed("model", "stream"))


def _zero_model(f: Fixtures) -> cox.CoxFit:
    terms = [survival.Numeric("age"), survival.Factor("sex", ("female", "male"))]
    return cox.coxph(retention.long_matrix(_cohort_table(f), terms), terms, model="stream", max_steps=0)


@query
def schoenfeld_at_zero(f: Fixtures) -> DataFrame:
    residuals = _zero_model(f).schoenfeld()
    return present(residuals.select("p_id", F.col("model").alias("stream"), "time", "term", "resid"))


@query
def concordance_of_baseline(f: Fixtures) -> DataFrame:
    """How well a continuous score of the baseline tells who drops out earlier."""
    table = _cohort_table(f).withColumn("risk", F.col("phq_base") * F.lit(2.0) + F.col("edu_age_align") / F.lit(1000.0))
    long = survival.dropout_long(table.filter(F.col("risk").isNotNull()), STREAMS, ("p_id", "risk"))
    scored = long.select(F.col("stream").alias("model"), F.col("duration").alias("time"), "event", "risk")
    return present(concordance.concordance(scored).withColumnRenamed("model", "stream"))


@query
def cox_summary_one_covariate(f: Fixtures) -> DataFrame:
    fit = _sex_model(f)
    joined = fit.summary().join(fit.concordance(), "model")
    return present(joined.select(F.col("model").alias("stream"), "n", "n_event", "loglik_null", "loglik", "lr", "df", "aic", "concordance", "pairs", "converged"), 5)


@query
def residual_covariance(f: Fixtures) -> DataFrame:
    """Covariance of all pairs of scaled residual columns: the three streams, and the phone model by episode with its columns combined."""
    table = durable(_cohort_table(f))
    episodes = retention.episode_model(table, COHORT_1, "phone", SITES)
    by_episode = episodes.residual_covariance().withColumn("model", F.lit("phone by episode"))
    return present(_fit(f, table).residual_covariance().unionByName(by_episode).withColumnRenamed("model", "stream"), 9)


@query
def residual_covariance_at_zero(f: Fixtures) -> DataFrame:
    return present(_zero_model(f).residual_covariance("resid").withColumnRenamed("model", "stream"))


@query
def residual_covariance_by_episode(f: Fixtures) -> DataFrame:
    """The effect of sex by episode: each episode's residual column, and the column of all episodes together."""
    return present(_episode_sex_model(f).residual_covariance().drop("model"), 5)


@query
def zph_test(f: Fixtures) -> DataFrame:
    return present(_fit(f).ph_test().withColumnRenamed("model", "stream"))
