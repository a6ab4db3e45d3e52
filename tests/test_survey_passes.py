"""The survey records are read once for all summaries, and participants of any size get the same result."""

import re

import pytest
from pyspark.sql import functions as F

from cohortwise.operators import summary

import __spark_entry__ as entry


@pytest.mark.parametrize("name, lines", [("baseline_max", 1), ("cluster_union_streams", 1), ("cluster_profile", 1)])
def test_order_lines_are_read_once_beside_the_written_records(spark, name, lines):
    text = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"ReadSchema: struct<l_orderkey", text)) == lines


def test_few_and_many_records_are_summed_up_alike(spark):
    rows = [(None if i % 5 == 0 else f"p{i % 7}", i % 40, float(i % 11), None if i == 23 else float(i * i % 17)) for i in range(400)]
    records = spark.createDataFrame(rows, "p_id string, days int, score double, lag double")
    columns = {"m": ("score", "mean"), "md": ("score", "median"), "lag": ("lag", "median"), "mlag": ("lag", "mean")}
    results = [{tuple(r) for r in summary.survey_period_summary(records, 30, columns, most=most).select("p_id", *[F.round(c, 9) for c in columns]).collect()} for most in (0, 41, 10_000)]
    assert results[0] == results[1] == results[2] and len(results[0]) == 8
    assert {r for r in results[0] if r[0] == "p5"} and sum(r[3] is None for r in results[0]) == 1


def test_the_baselines_of_both_scores_come_from_one_pass(spark):
    records = spark.createDataFrame([("a", 1, 3, 5), ("a", 2, 4, None), ("a", 9, 90, 90), ("b", 1, None, 2)], "p_id string, week int, x int, y int")
    assert {tuple(r) for r in summary.baseline_max(records, "x", "y").collect()} == {("a", 4, None), ("b", None, 2)}
