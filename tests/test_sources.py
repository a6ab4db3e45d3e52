"""Reading delivered tables, writing results, checkpoint folder."""

import datetime as dt

import pytest

from cohortwise.config import COHORT_1, COHORT_2
from cohortwise.operators import align
from cohortwise.plans import engagement, retention
from cohortwise.sources import durable, study, tables

FILES = {
    "participants": "subject_id,enrolment_date,withdrawal_date\na,2018-01-01,NA\nb,2018-02-01,2018-06-01\n",
    "active": "p_id,timestamp,dataName\na,2018-01-02 10:00:00,PHQ8\na,2018-12-01 10:00:00,RSES\nb,2018-02-03 00:00:00,ESM\nx,2018-02-03 00:00:00,ESM\n207,2018-02-03 00:00:00,ESM\n",
    "passive": "p_id,timestamp,dataName\na,2018-01-05 10:00:00,Passive_phone\nb,2018-02-05 10:00:00,Passive_Fitbit\nx,2018-02-03 00:00:00,Passive_phone\n",
    "assessment": "p_id,timestamp\na,2018-01-01 09:00:00\n",
    "demographics": "p_id,dob,age,sex,site,marry_align,children,edu_age_align,edu_degree_align,income_align,income_num,accommodation_occupy_align,accommodation_satisfy\n"
    "a,1980-01-01,38,female,s1,Single,Yes,18,d,low,1,Renting,ok\nb,NA,NA,male,s2,Married,No,20,d,low,2,Renting,ok\nx,NA,50,male,s2,Married,No,20,d,low,2,Renting,ok\nc,NA,51,male,s2,Married,No,20,d,low,2,Renting,ok\n",
    "contacts": "p_id,date,record_num,comms,site\na,2018-01-03 10:30,1,hello,s1\na,bad,2,hello,s1\n",
    "ids": "p_id,date,record_num,ids_score\na,2018-01-01 09:00:00,0,21\n",
    "phq8": "p_id,notification_time,start_time,end_time," + ",".join(f"s_{i}" for i in range(1, 9)) + "\na,-1,1514890800,1514890860,1,1,1,1,1,1,1,1\na,1514890000,1514890800,1514890860,1,1,1,1,1,1,1,NA\n",
    "rses": "p_id,notification_time,start_time,end_time," + ",".join(f"s_{i}" for i in range(1, 11)) + "\na,1514890000,1514890800,1514890860,3,0,3,3,0,0,3,0,0,3\n",
    "phone_brand": "p_id,phone_brand\na,1\nb,8\n",
    "employment": "subject_id,redcap_event_name,EMPLOYMENT_STATUS\na,enrolment_arm_1,Furloughed\na,later,Retired\nb,enrolment_arm_1,Pilot\n",
    "comorbidity": "p_id," + ",".join(f"ill_{i}" for i in range(19)) + "\na," + ",".join(["1", "1"] + ["0"] * 17) + "\nb," + ",".join(["0"] * 19) + "\n",
    "medication": "p_id,depression_medication\na,NA\nb,1\n",
    "ethnicity": "subject_id,ETHCAT2\na,White native\nb,Asian\n",
    "phone_status": "p_id,phone_status\na,3\nb,1\n",
}


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("study")
    paths = {}
    for name, text in FILES.items():
        paths[name] = str(folder / f"{name}.csv")
        (folder / f"{name}.csv").write_text(text)
    return study.load_study(spark, paths, dummy_ids=("207",))


def test_study_tables_are_cleaned(loaded):
    people = {r.p_id: r for r in loaded.demographics.collect()}
    assert set(people) == {"a", "b", "c"}
    a, b = people["a"], people["b"]
    assert (a.phone_brand, a.employment, a.comorb_sum, a.comorb, a.depression_medication, a.phone_status) == ("Samsung", "Yes", 2, 1, 0, 0)
    assert (b.phone_brand, b.employment, b.comorb, b.depression_medication, b.phone_status) == ("Other", "Not reported", 0, 1, 1)
    assert "dob" not in loaded.demographics.columns and people["c"].employment is None
    merged = {r.p_id: r.ETHCAT2 for r in study.merge_ethnicity(loaded.demographics).collect()}
    assert merged == {"a": "White", "b": "Asian", "c": None}


def test_events_of_people_without_enrolment_are_removed(loaded):
    assert {r.p_id for r in loaded.active.collect()} == {"a", "b", "207"}
    assert {r.p_id for r in loaded.passive.collect()} == {"a", "b"}
    assert {r.p_id for r in loaded.dates.collect()} == {"a", "b"}
    rows = {r.p_id: r for r in loaded.enrollment.collect()}
    assert rows["a"].withdrawal_date is None and rows["a"].delta_enrol_vs_study_start == 32


def test_surveys_and_visits(loaded):
    rows = sorted(loaded.phq8.collect(), key=lambda r: r.sum_phq8 is None)
    assert (rows[0].sum_phq8, rows[0].notification_time, rows[0].response_lag, rows[0].days, rows[0].week) == (8, None, None, 2, 1)
    assert (rows[1].sum_phq8, rows[1].response_lag, rows[1].activity) == (None, 800.0, "phq8")
    assert loaded.rses.first().sum_rses == 30
    contacts = sorted((str(r.date), r.record_num) for r in loaded.contacts.collect())
    assert contacts == [("2018-01-03", 1), ("None", 2)] and "comms" not in loaded.contacts.columns
    assert loaded.visits.first().date == dt.date(2018, 1, 1)


def test_whole_retention_and_engagement_run_on_study_tables(loaded):
    base = loaded.demographics.select("p_id").join(loaded.enrollment.select("p_id", "enrollment_date"), "p_id", "left")
    rows = {r.p_id: r for r in retention.dropout_labels(loaded.active, loaded.passive, loaded.enrollment, base, COHORT_1).collect()}
    assert (rows["a"].duration_active, rows["a"].event_active, rows["c"].duration_phone, rows["c"].event_phone) == (1, 1, 0, 1)
    members = align.cohort_members(align.days_in_study(loaded.active, loaded.enrollment), COHORT_2.horizon)
    assert members.count() == 0
    wide = engagement.all_stream_words(loaded.active, loaded.passive, loaded.enrollment, loaded.demographics, COHORT_1)
    got = {(r.p_id, r.stream): r.engaged for r in engagement.by_stream(wide, COHORT_1, (1,)).collect()}
    assert got[("a", "active")] == 1 and got[("a", "phone")] == 1 and got[("b", "fitbit")] == 1 and got[("c", "phone")] == 0


def test_id_list_round_trip(spark, tmp_path):
    ids = spark.createDataFrame([("a",), ("b-1",)], "p_id string")
    tables.write_id_list(ids, str(tmp_path / "ids.tsv"))
    assert sorted(r.p_id for r in tables.read_id_list(spark, str(tmp_path / "ids.tsv")).collect()) == ["a", "b-1"]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], "p_id string, phone_brand int")
    tables.write_csv(df, str(tmp_path / "out"))
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "out"), "phone_brand").collect())) == [("a", 1), ("b", None)]


def test_events_are_written_by_type_and_pruned(spark, tmp_path):
    df = spark.createDataFrame([("a", dt.datetime(2020, 1, 1), "x"), ("b", dt.datetime(2020, 1, 2), "y")], "p_id string, ts timestamp_ntz, data_name string")
    tables.write_events(df, str(tmp_path / "events"))
    back = spark.read.parquet(str(tmp_path / "events")).filter("data_name = 'x'")
    assert [r.p_id for r in back.collect()] == ["a"]
    assert "PartitionFilters: [isnotnull(data_name" in back._jdf.queryExecution().executedPlan().toString()


def test_checkpoint_folder_is_the_one_of_the_session(spark):
    folder = durable.ensure_checkpoint_dir(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is not None:
        assert folder.removeprefix("file:").startswith(configured.removeprefix("file:").rstrip("/"))
    assert durable.durable(spark.range(3)).count() == 3


def test_csv_columns_go_by_name(spark, tmp_path):
    (tmp_path / "active.csv").write_text('"",dataName,p_id,note,timestamp\n"1",PHQ8,a1,x,2020-01-02 03:04:05\n"2",NA,a2,y,NA\n')
    rows = tables.read_csv(spark, str(tmp_path / "active.csv"), "active").collect()
    assert [(r.p_id, r.timestamp, r.dataName) for r in rows] == [("a1", "2020-01-02 03:04:05", "PHQ8"), ("a2", None, None)]
    (tmp_path / "short.csv").write_text("p_id,timestamp\na1,2020\n")
    with pytest.raises(ValueError, match="dataName"):
        tables.read_csv(spark, str(tmp_path / "short.csv"), "active")
