"""The whole analysis on the benchmark tables in the roles of study tables."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cohortwise.config import COHORT_1, COHORT_2, PASSIVE_TYPES
from cohortwise.operators import align, describe, summary
from cohortwise.plans import cohort, queries
from cohortwise.plans.fixtures import Fixtures
from cohortwise.sources.durable import durable
from cohortwise.sources.study import Study, enrollment_dim


@pytest.fixture(scope="module")
def study(spark):
    f = Fixtures(spark, "/root/testdata/sf0.001")
    surveys = durable(summary.index_surveys(queries._surveys(f), f.enrollment(), "inner"))
    people = queries._people(f).withColumn("marry_align", F.when(F.col("p_id") % 2 == 0, "Married").otherwise("Single"))
    people = people.withColumn("children", F.when(F.col("p_id") % 5 < 2, "Yes").otherwise("No"))
    clinical = f.visit_dates()
    return Study(
        enrollment=durable(enrollment_dim(f.enrollment())), active=f.active(), passive=durable(f.passive()),
        clinical=clinical.withColumn("ts", F.col("date").cast("timestamp_ntz")), demographics=durable(people),
        contacts=f.contacts(), visits=f.visits(), phq8=surveys, rses=surveys,
        dates=align.participant_dates(f.active(), f.passive(), clinical, f.enrollment(), PASSIVE_TYPES),
    )


def test_selection_and_lists(study, tmp_path):
    results = cohort.select_cohorts(study)
    first, second = (results[f"members_{c.name}"].count() for c in (COHORT_1, COHORT_2))
    assert first >= second > 0
    cohort.write_results({"members_cohort_1": results["members_cohort_1"], "quantiles": results["quantiles"]}, str(tmp_path))
    assert (tmp_path / "members_cohort_1.tsv").exists() and (tmp_path / "quantiles").exists()


@pytest.mark.parametrize("which", [COHORT_1, COHORT_2], ids=lambda c: c.name)
def test_retention(study, which):
    results = cohort.retention_tables(study, which)
    assert {r.stream for r in results["curves"].collect()} == {"active", "phone", "fitbit"}
    assert results["forest"].filter("variable = 'children_cat'").count() == 6
    expected = {f"episodes_{s}" for s in which.episodes}
    assert expected <= set(results)
    for name in expected:
        assert results[name].filter("hr_text is not null").count() > 5
    assert results["proportionality"].filter("term = 'GLOBAL'").count() == 3


def test_engagement(study):
    results = cohort.engagement_tables(study, COHORT_1, k_max=3)
    people = study.demographics.count()
    for stream in ("active", "phone", "fitbit"):
        members = results[f"{stream}_members"].collect()
        assert len(members) == people and {r.cluster for r in members} == {"C1", "C2", "C3"}
        assert results[f"{stream}_comparison"].filter("section = 'depression'").count() == 12
    assert results["streams"].count() == 3 * people
    known = describe.melt(results["streams"], ["cat", "cluster"], ["sum_phq8", "phq8_response_min", "phq8_total_s", "age"]).dropna()
    assert results["boxplots"].count() == known.select("cat", "cluster", "variable").distinct().count() > 30


@pytest.fixture(scope="module")
def half(study):
    """A cohort whose window only half of the participants could be observed for, and its members."""
    days = align.days_in_study(study.active, study.enrollment)
    horizon = days.filter("type = 'theoretical_max'").agg(F.percentile_approx("value", 0.5)).first()[0]
    members = durable(align.cohort_members(days, horizon))
    assert 0 < align.keep_ids(study.demographics, members).count() < study.demographics.count()
    return replace(COHORT_2, horizon=horizon), members


def test_retention_of_members_only(study, half):
    chosen, members = half
    got = cohort.retention_tables(study, replace(chosen, episodes={}))
    people = align.keep_ids(study.demographics, members).count()
    assert {r.n for r in got["curves"].groupBy("stream").agg(F.max("n_risk").alias("n")).collect()} == {people}
    same = cohort.retention_tables(cohort.restrict(study, members), replace(chosen, episodes={}, members_only=False))
    assert sorted(same["curves"].collect(), key=repr) == sorted(got["curves"].collect(), key=repr)


def test_engagement_of_members_only(study, half):
    """Members only; the phone profile ignores missing baseline scores, the others don't."""
    chosen, members = half
    inside = align.keep_ids(study.phq8.filter("week in (1, 2)"), members, ["start_time"])
    gap = durable(inside.orderBy("p_id", "start_time").limit(1))
    broken = replace(study, phq8=durable(study.phq8.unionByName(gap.withColumn("sum_phq8", F.lit(None).cast("int")).select(study.phq8.columns))))
    streams = cohort.engagement_tables(broken, chosen, k_max=2)["streams"]
    assert streams.count() == 3 * align.keep_ids(study.demographics, members).count()
    assert {r.cat: r.sum_phq8 is None for r in streams.join(gap.select("p_id"), "p_id").collect()} == {"Phone-Active": True, "Phone-Passive": False, "Fitbit-Passive": True}


def test_demographics(study):
    results = cohort.demographics_tables(study, COHORT_1)
    people = study.demographics.count()
    sites = {r.site: r.n for r in results["site_summary"].collect()}
    assert sites[None] == people == sum(n for s, n in sites.items() if s is not None)
    tests = {r.variable: r.df for r in results["site_tests"].collect()}
    assert tests["age"] == 4 and tests["sex"] == 4
    assert results["missing"].filter("column_name = 'p_id'").first().n_null == 0
