"""Order lines are dealt once: their orders bring the enrolment date, and lines are cut to the horizon before they are grouped."""

import collections

import pytest

import __spark_entry__ as entry
from cohortwise.operators import align
from cohortwise.plans.fixtures import Fixtures

FOLDER = "/root/testdata/sf0.001"


def subtrees(text, root):
    """The plan nodes that ``root`` accepts, with all nodes below them."""
    lines = text.split("\n")
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    for i, line in enumerate(lines):
        if root(line):
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            yield "\n".join(lines[i:end])


@pytest.mark.parametrize("name", ["baseline_max", "cluster_union_streams", "cluster_profile", "engagement_counts"])
def test_no_line_is_dealt_by_participant_before_it_is_cut(spark, name):
    text = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    salted = list(subtrees(text, lambda line: "Join" in line and "__salt" in line))
    assert salted and not any("l_orderkey" in tree for tree in salted)
    daily = subtrees(text, lambda line: "Aggregate [" in line and "day" in line.split("],")[0])
    assert not any("l_orderkey" in tree for tree in daily)


@pytest.mark.parametrize("table", ["active", "passive", "survey"])
def test_dated_tables_hold_the_records_of_enrolled_participants(spark, table):
    f = Fixtures(spark, FOLDER)
    enrollment = f.enrollment().filter("p_id % 4 != 1")
    dated, plain = getattr(f, table)(enrollment), getattr(f, table)()
    expected = align.attach_enrollment(plain, enrollment).select(dated.columns)
    assert collections.Counter(map(tuple, dated.collect())) == collections.Counter(map(tuple, expected.collect()))
    assert 0 < dated.count() < plain.count()
