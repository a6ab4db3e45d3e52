"""From delivered study tables to the cleaned tables the operators work on."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.config import PASSIVE_TYPES, STUDY_START
from cohortwise.functions.coding import collapse, recode
from cohortwise.operators import align, summary
from cohortwise.sources import tables

# Category groups and code lists of the attribute tables.
PHONE_BRANDS = {1: "Samsung", 2: "Other", 3: "Other", 4: "Motorola", 5: "Other", 6: "Other", 7: "Other", 8: "Other"}
EMPLOYMENT_GROUPS = {
    "Yes": ("Employed", "Furloughed"),
    "No": ("Unemployed", "Off sick", "Housewife/husband", "Student", "Retired"),
}
ETHNICITY_GROUPS = {"White native": "White", "White Other": "White", "Mixed ethnic background": "Other"}
ENROLMENT_EVENT = "enrolment_arm_1"
ILLNESS_FLAGS = tuple(f"ill_{i}" for i in range(19))


@dataclass(frozen=True)
class Study:
    """Cleaned tables of one study."""

    enrollment: DataFrame
    active: DataFrame
    passive: DataFrame
    clinical: DataFrame
    demographics: DataFrame
    contacts: DataFrame
    visits: DataFrame
    phq8: DataFrame
    rses: DataFrame
    dates: DataFrame


def enrollment_dim(enrollment: DataFrame) -> DataFrame:
    """Participant dimension with the days from study start to enrolment."""
    start = F.lit(STUDY_START)
    return enrollment.select(
        "p_id", "enrollment_date", "withdrawal_date",
        F.date_diff("enrollment_date", start).alias("delta_enrol_vs_study_start"),
    )


def brand_label(column: str = "phone_brand"):
    return recode(column, PHONE_BRANDS)


def employment_label(column: str):
    return collapse(column, EMPLOYMENT_GROUPS, "Not reported")


def merge_ethnicity(demographics: DataFrame, column: str = "ETHCAT2") -> DataFrame:
    """Put the finer ethnicity categories together."""
    return demographics.withColumn(column, recode(column, ETHNICITY_GROUPS))


def demographics_star(
    demographics: DataFrame, brand: DataFrame, employment: DataFrame, comorbidity: DataFrame, medication: DataFrame,
    ethnicity: DataFrame, phone_status: DataFrame,
) -> DataFrame:
    """Demographics with the attribute tables joined on ``p_id``."""
    brands = brand.select("p_id", brand_label().alias("phone_brand"))
    jobs = employment.filter(F.col("redcap_event_name") == ENROLMENT_EVENT).select(
        F.col("subject_id").alias("p_id"), employment_label("EMPLOYMENT_STATUS").alias("employment")
    )
    illness = summary.count_flags(comorbidity, ILLNESS_FLAGS, "comorb_sum", "comorb").select("p_id", "comorb_sum", "comorb")
    drugs = medication.select("p_id", F.coalesce("depression_medication", F.lit(0)).alias("depression_medication"))
    races = ethnicity.select(F.col("subject_id").alias("p_id"), "ETHCAT2")
    status = phone_status.select(
        "p_id", F.when(F.col("phone_status") == 3, 0).otherwise(F.col("phone_status")).alias("phone_status")
    )
    return summary.star(demographics.drop("dob"), brands, jobs, illness, drugs, races, status)


def load_study(spark: SparkSession, paths: dict[str, str], dummy_ids: Sequence[str] = ()) -> Study:
    """Read and clean the study's CSV tables; ``paths`` maps the schema names to files.

    People on the dummy list are left out of the date table. Whoever is in the
    date table without an enrolment is left out of all tables; the records of
    dummy people go at the first join with the enrolment table.
    """
    raw = {name: tables.read_csv(spark, path, name) for name, path in paths.items()}
    enrollment = enrollment_dim(tables.enrollment_from_raw(raw["participants"]))
    active = tables.events_from_raw(raw["active"])
    passive = tables.events_from_raw(raw["passive"])
    clinical = tables.events_from_raw(raw["assessment"]).withColumn("date", F.to_date("ts"))
    visits = tables.dated_records(raw["ids"], "yyyy-MM-dd HH:mm:ss")
    contacts = tables.dated_records(raw["contacts"], "yyyy-MM-dd HH:mm")
    dates = align.drop_ids(align.participant_dates(active, passive, clinical, enrollment, PASSIVE_TYPES), dummy_ids)
    outside = align.unenrolled_ids(dates, enrollment)

    def surveys(name: str) -> DataFrame:
        scored = summary.score_surveys(summary.clean_notifications(raw[name], name))
        return align.remove_ids(summary.index_surveys(scored, enrollment), outside, ["start_time"])

    star = demographics_star(
        *[raw[name] for name in ("demographics", "phone_brand", "employment", "comorbidity", "medication", "ethnicity", "phone_status")]
    )
    return Study(
        enrollment=enrollment,
        active=align.remove_ids(active, outside, ["ts"]),
        passive=align.remove_ids(passive, outside, ["ts"]),
        clinical=align.remove_ids(clinical, outside, ["ts"]),
        demographics=align.remove_ids(star, outside),
        contacts=contacts,
        visits=visits,
        phq8=surveys("phq8"),
        rses=surveys("rses"),
        dates=align.remove_ids(dates, outside),
    )
