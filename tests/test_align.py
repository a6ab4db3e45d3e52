"""Timelines, horizons, grids and per-participant summaries."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortwise.operators import align, cluster, grid, summary

D = dt.date
T = dt.datetime


@pytest.fixture(scope="module")
def enrollment(spark):
    return spark.createDataFrame([("a", D(2020, 1, 1)), ("b", D(2020, 1, 10))], "p_id string, enrollment_date date")


def events(spark, rows):
    return spark.createDataFrame(rows, "p_id string, ts timestamp_ntz, data_name string")


def test_last_activity_bound_is_midnight(spark, enrollment):
    df = events(spark, [
        ("a", T(2020, 1, 3, 9), "x"), ("a", T(2020, 1, 11), "x"), ("a", T(2020, 1, 11, 0, 0, 1), "x"), ("a", T(2020, 1, 20, 8), "x"),
        ("b", T(2020, 1, 20, 0, 0, 1), "x"), ("b", T(2020, 1, 2), "x"), ("c", T(2020, 1, 2), "x"),
    ]).withColumnRenamed("data_name", "stream")
    rows = {r.p_id: (r.last_h, r.last_grace) for r in align.last_activity(df, enrollment, 10, 20).collect()}
    assert rows == {"a": (T(2020, 1, 11), T(2020, 1, 20, 8)), "b": (T(2020, 1, 2), T(2020, 1, 20, 0, 0, 1))}


def test_enrichment_can_be_repeated(spark, enrollment):
    df = events(spark, [("a", T(2020, 1, 3), "x")])
    once = align.attach_enrollment(df, enrollment)
    assert align.attach_enrollment(once, enrollment).collect() == once.collect()


def test_participant_dates_keep_every_id(spark, enrollment):
    active = events(spark, [("a", T(2020, 1, 3), "PHQ8"), (None, T(2020, 1, 4), "PHQ8")])
    passive = events(spark, [(None, T(2020, 2, 1), "Passive_phone"), ("z", T(2020, 2, 2), "Passive_other")])
    clinical = spark.createDataFrame([("a", D(2020, 3, 1))], "p_id string, date date")
    dates = align.participant_dates(active, passive, clinical, enrollment, {"phone": "Passive_phone"})
    rows = {r.p_id: r for r in dates.collect()}
    assert set(rows) == {"a", "b", "z", None}
    assert (rows[None].active_first, rows[None].phone_first) == (D(2020, 1, 4), D(2020, 2, 1))
    assert rows["z"].phone_first is None and rows["z"].passive_last == D(2020, 2, 2)
    assert rows["b"].enrollment_date == D(2020, 1, 10) and rows["a"].clin_last == D(2020, 3, 1)
    assert sorted(str(r.p_id) for r in align.unenrolled_ids(dates, enrollment).collect()) == ["None", "z"]


def test_days_in_study(spark, enrollment):
    active = events(spark, [("a", T(2020, 2, 1, 5), "x"), ("z", T(2021, 1, 1), "x")])
    rows = {(r.p_id, r.type): r.value for r in align.days_in_study(active, enrollment).collect()}
    assert rows == {("a", "theoretical_max"): 32, ("a", "actual_days"): 32, ("b", "theoretical_max"): 23, ("b", "actual_days"): 1}
    members = align.cohort_members(align.days_in_study(active, enrollment), 30)
    assert [r.p_id for r in members.collect()] == ["a"]


@pytest.mark.parametrize("bins", [22, 64, 65, 301])
def test_bit_words_equal_the_dense_grid(spark, bins):
    active = {"a": {1, bins, 7}, "b": set()}
    rows = [("a", b) for b in active["a"] for _ in range(3)] + [("a", 0), ("a", bins + 1), ("x", 2)]
    words = grid.activity_words(spark.createDataFrame(rows, "p_id string, bin int"), bins)
    full = grid.all_participants(words, spark.createDataFrame([("a",), ("b",)], "p_id string"))
    dense = {(r.p_id, r.bin): r.active for r in grid.activity_grid(full, bins).collect()}
    expected = {(p, b): int(b in s) for p, s in {**active, "x": {2}}.items() for b in range(1, bins + 1)}
    assert dense == expected
    names = grid.word_names(bins)
    vectors = full.select("p_id", grid.activity_vector(names, bins).alias("v"), grid.count_bits(names).alias("n"), grid.active_bins(names, bins).alias("b"))
    for row in vectors.collect():
        assert row.v == [expected[(row.p_id, b)] for b in range(1, bins + 1)]
        assert row.n == sum(row.v) and row.b == [b for b in range(1, bins + 1) if expected[(row.p_id, b)]]
    wide = {r.p_id: r.asDict() for r in grid.activity_wide(full, bins).collect()}
    assert wide["a"][f"b{bins}"] == 1 and wide["b"][f"b{bins}"] == 0


def test_bin_rate_lists_bins_without_activity(spark):
    df = spark.createDataFrame([("C1", [1, 3]), ("C1", [3]), ("C2", [])], "cluster string, active array<int>").withColumn("bins", F.lit(3))
    rows = {(r.cluster, r.bin): (r.n, r.active_rate) for r in cluster.bin_rate(df, ["cluster"]).collect()}
    assert rows == {("C1", 1): (2, 0.5), ("C1", 2): (2, 0.0), ("C1", 3): (2, 1.0), ("C2", 1): (1, 0.0), ("C2", 2): (1, 0.0), ("C2", 3): (1, 0.0)}


def test_baselines_with_ties_and_nulls(spark):
    df = spark.createDataFrame(
        [("a", None, 1, 9, 1), ("a", T(2020, 1, 2), 5, 7, 1), ("a", T(2020, 1, 2), 4, 3, 2), ("b", T(2020, 1, 1), 1, None, 1), ("b", T(2020, 1, 2), 1, 6, 3)],
        "p_id string, start_time timestamp_ntz, total_time_taken int, score int, week int",
    )
    first = {r.p_id: r.score for r in summary.baseline_first(df, "score", ("total_time_taken",)).collect()}
    assert first == {"a": 3, "b": None}
    assert {r.p_id: r.score for r in summary.baseline_max(df, "score").collect()} == {"a": 9, "b": None}
    top = {r.p_id: (r.score, r.total_time_taken) for r in summary.baseline_top1(df, "score", ["total_time_taken"], order=["total_time_taken"]).collect()}
    assert top == {"a": (9, 1)}


def test_period_summary_is_unknown_when_a_value_is_missing(spark):
    df = spark.createDataFrame(
        [("a", 1, 2.0, 10.0), ("a", 2, 4.0, None), ("a", 400, 100.0, 1.0), ("b", 5, 1.0, 1.0), ("b", -4, 2.0, 2.0), ("b", 6, 9.0, 6.0)],
        "p_id string, days int, score double, lag double",
    )
    stats = summary.survey_period_summary(df, 301, {"m": ("score", "mean"), "md": ("score", "median"), "lag": ("lag", "median")})
    assert {r.p_id: (r.m, r.md, r.lag) for r in stats.collect()} == {"a": (3.0, 3.0, None), "b": (4.0, 2.0, 2.0)}


def test_contact_count_and_visits(spark, enrollment):
    rows = [("a", D(2019, 12, 1), 0), ("a", D(2020, 1, 5), 1), ("a", D(2021, 6, 1), 2), ("b", D(2020, 1, 11), None), ("b", D(2021, 6, 1), 0)]
    df = spark.createDataFrame(rows, "p_id string, date date, record_num int").withColumn("ids_score", F.lit(7))
    assert {r.p_id: r.num_contact for r in summary.contact_count(df, enrollment, 301).collect()} == {"a": 1, "b": 0}
    visits = {r.p_id: (r.count_ids, r.baseline_ids) for r in summary.visit_summary(df, enrollment, 301).collect()}
    assert visits == {"a": (2, 7), "b": (2, 7)}


def test_record_numbers_follow_time(spark):
    rows = [("a", T(2020, 1, 1, h), i) for i, h in enumerate([5, 3, 9])] + [("a", T(2020, 1, 2), 9), ("a", T(2019, 1, 1), 8), (None, T(2020, 1, 1), 1)]
    df = summary.number_records(spark.createDataFrame(rows, "p_id string, ts timestamp_ntz, k int"), "p_id", "ts", ["k"])
    got = {(r.p_id, r.k): r.record_num for r in df.collect()}
    assert got == {("a", 8): 0, ("a", 1): 1, ("a", 0): 2, ("a", 2): 3, ("a", 9): 4, (None, 1): 0}


def test_notifications_without_a_time(spark):
    raw = spark.createDataFrame([("a", -1.0, 100.0, 160.5), ("a", 40.0, 100.0, 160.0)], "p_id string, notification_time double, start_time double, end_time double")
    rows = summary.clean_notifications(raw, "esm").orderBy("total_time_taken").collect()
    assert [(r.response_lag, r.total_time_taken, r.activity) for r in rows] == [(60.0, 60.0, "esm"), (None, 60.5, "esm")]
    assert rows[1].notification_time is None and rows[0].start_time == T(1970, 1, 1, 0, 1, 40)


def test_star_replaces_repeated_columns_and_keeps_unmatched(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "p_id string, x int")
    other = spark.createDataFrame([("a", 9, 5)], "p_id string, x int, y int")
    rows = {r.p_id: (r.x, r.y) for r in summary.star(base, other).collect()}
    assert rows == {"a": (9, 5), "b": (None, None)}


def test_results_do_not_depend_on_partitioning(spark, enrollment):
    rows = [("a" if i % 3 else "b", T(2020, 1, 1) + dt.timedelta(hours=5 * i), "x") for i in range(200)]
    df = events(spark, rows)
    one = {tuple(r) for r in align.daily_activity(df.coalesce(1), enrollment, 30).collect()}
    many = {tuple(r) for r in align.daily_activity(df.repartition(11), enrollment, 30).collect()}
    assert one == many and one
