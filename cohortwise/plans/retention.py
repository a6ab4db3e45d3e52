"""Retention analysis: labels per data stream, cohort table and model terms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from cohortwise.config import PASSIVE_TYPES, STREAMS, Cohort
from cohortwise.functions.coding import cap, flag, keep_listed, lower_bands, recode, upper_bands
from cohortwise.operators import align, cox, summary, survival

# Age and severity bands, category labels and factor levels.
AGE_EDGES = ((29, "<30"), (39, "30-39"), (49, "40-49"), (59, "50-59"))
AGE_BEYOND = ">60"
AGE_LEVELS = ("<30", "30-39", "40-49", "50-59", ">60")
PHQ_EDGES = ((0, "no depressive symptoms"), (5, "mild"), (10, "moderate"), (15, "moderately severe"), (20, "severe"))
INCOME_LEVELS = ("below minimum", "15,000-55,000", "more than 55000")
ACCOMMODATION_LEVELS = ("Own outright/with mortgage", "Renting", "Living rent-free")
MARRY_LABELS = {"Married/cohabiting/Long term relationship": "Married", "Single/separated/divorced/widowed": "Single"}
MARRY_LEVELS = ("Single", "Married")
BRAND_LEVELS = ("Other", "Motorola", "Samsung")
YES_NO = ("No", "Yes")


def dropout_labels(active: DataFrame, passive: DataFrame, enrollment: DataFrame, base: DataFrame, cohort: Cohort) -> DataFrame:
    """``base`` with duration and event of the three streams, one row per participant."""
    events = align.tag_streams(active, passive, PASSIVE_TYPES)
    last = align.last_activity_wide(events, enrollment, STREAMS, cohort.horizon, cohort.grace)
    return survival.dropout_wide(base, last, STREAMS, cohort.horizon, cohort.day_offset)


def model_covariates(cohort_table: DataFrame, missing_age_is_oldest: bool = False) -> DataFrame:
    """Banded and restricted covariates for the hazard models, for the columns that are present."""
    derived = {
        "age": ("age_band", upper_bands("age", AGE_EDGES, AGE_BEYOND, missing_age_is_oldest)),
        "phq_base": ("phq_band", lower_bands("phq_base", PHQ_EDGES)),
        "marry_align": ("marry_cat", keep_listed(recode("marry_align", MARRY_LABELS), MARRY_LEVELS)),
        "employment": ("employment_cat", keep_listed("employment", YES_NO)),
        "children": ("children_cat", keep_listed("children", YES_NO)),
        "income_align": ("income_cat", keep_listed("income_align", INCOME_LEVELS)),
        "accommodation_occupy_align": ("accommodation_cat", keep_listed("accommodation_occupy_align", ACCOMMODATION_LEVELS)),
        "income_num": ("income_num", cap("income_num", 3)),
        "phone_status": ("phone_status_cat", flag("phone_status", 1)),
    }
    present = [pair for source, pair in derived.items() if source in cohort_table.columns]
    return cohort_table.withColumns(dict(present))


def survival_cohort(
    demographics: DataFrame, enrollment: DataFrame, labels: DataFrame, contacts: DataFrame | None, baseline: DataFrame
) -> DataFrame:
    """Demographics with enrolment, dropout labels, contact count and baseline score.

    People who never enrolled but are in the demographics stay, with duration 0.
    """
    tables = [labels] if contacts is None else [labels, contacts]
    return summary.star(demographics, *tables, baseline.withColumnRenamed("sum_phq8", "phq_base"))


def model_terms(
    columns: Sequence[str], site_levels: Sequence[str], by_stratum: str | None = None, stratum_values: Sequence[int] = (),
    levels: Mapping[str, Sequence] | None = None, numeric_phone_status: bool = False,
) -> list:
    """Terms of the hazard models whose columns are present.

    The effect of the column ``by_stratum`` may differ between follow-up
    episodes. ``levels`` replaces a factor's level order, and thereby its
    reference. ``numeric_phone_status`` takes the phone status code as a number.
    """
    factors = {
        "age_band": AGE_LEVELS,
        "sex": ("female", "male"),
        "marry_cat": MARRY_LEVELS,
        "employment_cat": YES_NO,
        "children_cat": YES_NO,
        "edu_age_align": None,
        "income_cat": INCOME_LEVELS,
        "accommodation_cat": ACCOMMODATION_LEVELS,
        "phq_base": None,
        "comorb": (0, 1),
        "depression_medication": (0, 1),
        "site": tuple(site_levels),
        "phone_brand": BRAND_LEVELS,
        **({"phone_status": None} if numeric_phone_status else {"phone_status_cat": (0, 1)}),
    }
    terms = []
    for name, values in factors.items():
        if name not in columns:
            continue
        values = (levels or {}).get(name, values)
        term = survival.Numeric(name) if values is None else survival.Factor(name, tuple(values))
        terms.append(survival.ByStratum(term, "tgroup", tuple(stratum_values)) if name == by_stratum else term)
    return terms


def long_matrix(cohort_table: DataFrame, terms: list, streams=STREAMS) -> DataFrame:
    """Design matrix with one row per participant and stream."""
    labels = [f"{kind}_{stream}" for stream in streams for kind in ("duration", "event")]
    matrix = survival.design_matrix(cohort_table, terms, ["p_id", *labels])
    return survival.dropout_long(matrix, streams, ("p_id", "x"))


def episode_model(cohort_table: DataFrame, cohort: Cohort, stream: str, site_levels: Sequence[str]) -> cox.CoxFit:
    """Model of one stream with a covariate effect per follow-up episode, stratified by episode."""
    cuts, column = cohort.episodes[stream]
    table = cohort_table.withColumnsRenamed({f"duration_{stream}": "duration", f"event_{stream}": "event"})
    terms = model_terms(
        table.columns, site_levels, column, range(1, len(cuts) + 2), cohort.relevel, cohort.numeric_phone_status
    )
    rows = survival.episode_split(table, cuts)
    matrix = survival.design_matrix(rows, terms, ["p_id", "tgroup", "tstop", "event"])
    return cox.coxph(matrix, terms, stratum="tgroup", time="tstop")
