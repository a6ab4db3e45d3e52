"""Null rules, dates, recoding and p-values on hand-made rows."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from cohortwise.functions import calendar, coding, nulls, pvalues
from cohortwise.operators import align, report


def one(df, column):
    return [row[column] for row in df.collect()]


def test_strict_aggregates_are_null_when_a_value_is_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), ("b", 2.0)], "g string, x double")
    got = {r.g: (r.m, r.s, r.md) for r in df.groupBy("g").agg(
        nulls.strict(F.max, "x").alias("m"), nulls.strict(F.sum, "x").alias("s"), nulls.strict(F.median, "x").alias("md")).collect()}
    assert got == {"a": (None, None, None), "b": (2.0, 2.0, 2.0)}


def test_membership_of_null(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "p_id string")
    assert sorted(one(align.drop_ids(df, ["a"]), "p_id"), key=str) == [None, "b"]
    assert df.filter(nulls.within("p_id", ["a"])).count() == 2


def test_null_safe_joins(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "p_id string, x int")
    right = spark.createDataFrame([("a", 10), (None, 20)], "p_id string, y int")
    rows = {r.p_id: r.y for r in nulls.null_safe_join(left, right, ["p_id"], "left").collect()}
    assert rows == {"a": 10, None: 20, "c": None}
    assert one(align.remove_ids(left, right), "p_id") == ["c"]


def test_distinct_count_with_null(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "p_id string")
    assert df.agg(nulls.count_distinct_with_null("p_id").alias("n")).first().n == 2
    tagged = df.withColumn("stream", F.lit("s"))
    assert align.distinct_participants(tagged).first().n_participants == 2


def test_weeks_before_enrolment_round_down(spark):
    df = spark.createDataFrame([(-3,), (0,), (1,), (6,), (7,), (14,), (15,)], "d int")
    rows = df.select(calendar.week_from_zero("d").alias("a"), calendar.bin_of("d", 7).alias("b"), calendar.bin_of("d", 14).alias("c")).collect()
    assert [r.a for r in rows] == [0, 1, 1, 1, 2, 3, 3]
    assert [r.b for r in rows] == [0, 0, 1, 1, 1, 2, 3]
    assert [r.c for r in rows] == [0, 0, 1, 1, 1, 1, 2]


def test_instants_do_not_depend_on_the_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.createDataFrame([(1511996400.25, "2018-03-25 01:30:00", "2018-03-25 03:30:00")], "e double, a string, b string")
        row = df.select(
            calendar.epoch_seconds_to_ts("e").alias("ts"),
            calendar.seconds_between(calendar.text_to_ts("b"), calendar.text_to_ts("a")).alias("s"),
            calendar.text_to_ts(F.lit("junk")).alias("bad"),
            calendar.text_to_date(F.lit("2018-02-30")).alias("day"),
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert row.ts == dt.datetime(2017, 11, 29, 23, 0, 0, 250000)
    assert row.s == 7200.0 and row.bad is None and row.day is None


def test_bin_labels(spark):
    df = spark.range(0, 29).select(calendar.bin_label("id").alias("l"))
    labels = one(df, "l")
    assert (labels[0], labels[14], labels[28]) == ("1", "3", "5") and set(labels) == {"1", "3", "5", ""}


def test_bands_and_missing_values(spark):
    df = spark.createDataFrame([(29.0,), (29.5,), (59.5,), (None,)], "age double")
    edges = ((29, "<30"), (39, "30-39"), (49, "40-49"), (59, "50-59"))
    assert one(df.select(coding.upper_bands("age", edges, ">60").alias("b")), "b") == ["<30", "30-39", ">60", None]
    assert one(df.select(coding.upper_bands("age", edges, ">60", True).alias("b")), "b")[-1] == ">60"
    scores = spark.createDataFrame([(-1,), (4,), (5,), (24,), (None,)], "s int")
    assert one(scores.select(coding.lower_bands("s", ((0, "no"), (5, "mild"), (20, "severe"))).alias("b")), "b") == [None, "no", "mild", "severe", None]


def test_recoding(spark):
    df = spark.createDataFrame([(1, "x"), (7, "y"), (0, None), (None, "z")], "c int, s string")
    labels = {1: "Samsung", 7: "Other"}
    assert one(df.select(coding.recode("c", labels).alias("r")), "r") == ["Samsung", "Other", "0", None]
    assert one(df.select(coding.recode("c", labels, False).alias("r")), "r") == ["Samsung", "Other", None, None]
    assert one(df.select(coding.collapse("s", {"Yes": ["x"]}, "Not reported").alias("r")), "r") == ["Yes", "Not reported", "Not reported", "Not reported"]
    assert one(df.select(coding.flag("c").alias("r")), "r") == [1, 0, 0, 0]
    assert one(df.select(coding.level_position("s", ["y", "x"]).alias("r")), "r") == [2, 1, None, None]
    assert one(df.select(coding.cap("c", 3).alias("r")), "r") == [1, 3, 0, None]
    assert one(df.select(coding.drop_above("c", 3).alias("r")), "r") == [1, None, 0, None]
    hot = df.select(*[c.alias(f"h{i}") for i, c in enumerate(coding.one_hot("s", ["x", "y"]))])
    assert one(hot, "h0") == [0.0, 1.0, None, None]


def test_item_sum_with_reversed_items(spark):
    df = spark.createDataFrame([(1, 2, 3), (1, None, 3)], "s_1 int, s_2 int, s_3 int")
    assert one(df.select(coding.item_sum(["s_1", "s_2", "s_3"], ["s_2"]).alias("t")), "t") == [5, None]


@pytest.mark.parametrize("x, df, expected", [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (7.814727903251179, 3, 0.05), (18.307038053275146, 10, 0.05), (0.0, 4, 1.0)])
def test_chi_square_tail(x, df, expected):
    assert pvalues.chi_square_tail(x, df) == pytest.approx(expected, abs=1e-12)


def test_chi_square_tail_of_large_tables_is_stable():
    assert 0.0 <= pvalues.chi_square_tail(5000.0, 4000) < 1e-20
    assert pvalues.chi_square_tail(math.nan, 3) is None
    assert pvalues.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)


def test_hazard_ratio_text(spark):
    df = spark.createDataFrame([("m", "t", 0.125, 0.5, 12.0, 0.005)], "model string, term string, hr double, lower double, upper double, p double")
    row = report.hazard_ratio_report(df).first()
    assert (row.hr_text, row.p_text) == ("0.12 (0.5-12)", "0")
