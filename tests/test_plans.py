"""Properties of the physical plans that matter at scale."""

import re

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
MODELS = {"cox_coefficients", "cox_one_covariate", "zph_one_covariate", "cox_episode_effect", "cox_summary", "cox_stratified", "cox_stratified_cohort_2", "hr_report", "forest_table", "zph_test",
          "schoenfeld_residuals", "schoenfeld_at_zero", "residual_covariance", "residual_covariance_at_zero", "residual_covariance_by_episode", "concordance_of_baseline",
          "cox_summary_one_covariate", "wss_curve", "kmeans_assign", "cluster_labels", "cluster_labels_cohort_2"}


def plan(spark, name):
    return entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - MODELS))
def test_no_product_joins_and_no_python_on_rows(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text and "FlatMapGroups" not in text


@pytest.mark.parametrize("name", ["km_curve", "activity_vector", "activity_grid_daily", "last_activity", "baseline_top1", "survey_period_summary", "table_one_continuous", "cluster_membership"])
def test_nothing_is_gathered_in_one_partition(spark, name):
    text = plan(spark, name)
    assert "SinglePartition" not in text


def test_scans_read_only_needed_columns(spark):
    text = plan(spark, "daily_activity")
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert schemas and all("l_extendedprice" not in s and "o_totalprice" not in s for s in schemas)
    assert "PushedFilters: [IsNotNull(l_orderkey)]" in text


def test_activity_words_use_fixed_width_hash_aggregation(spark):
    text = plan(spark, "activity_vector")
    assert "ObjectHashAggregate" not in text and "partial_bit_or" in text
