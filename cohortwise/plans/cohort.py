"""The whole analysis of a study, cohort by cohort.

Each function returns named result tables; ``write_results`` puts them into one
folder per table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.config import COHORT_1, COHORT_2, RSES_MAX, STREAM_LABELS, STREAMS, Cohort
from cohortwise.functions.coding import drop_above
from cohortwise.functions.spread import hot_join
from cohortwise.operators import align, cluster, compare, cox, describe, grid, lloyd, patterns, ranks, report, summary, survival
from cohortwise.plans import engagement, retention
from cohortwise.sources.durable import durable
from cohortwise.sources.study import Study, merge_ethnicity
from cohortwise.sources.tables import write_csv, write_id_list

NUMBERS = ("age", "edu_age_align", "sum_phq8", "sum_rses", "num_contact", "count_ids", "baseline_ids", "engaged_days")
FACTORS = ("sex", "marry_align", "ETHCAT2", "employment", "children", "income_align", "accommodation_occupy_align", "comorb",
           "depression_medication", "phone_brand", "phone_status", "site")


def select_cohorts(study: Study) -> dict[str, DataFrame]:
    """Quantiles and densities of the days in study, and the member list of each cohort."""
    days = durable(align.days_in_study(study.active, study.enrollment))
    return {
        "quantiles": describe.quantile_grid(days, "type", 0.05),
        "density": describe.density_grid(days, "type"),
        **{f"members_{c.name}": align.cohort_members(days, c.horizon) for c in (COHORT_1, COHORT_2)},
    }


def restrict(study: Study, members: DataFrame) -> Study:
    """The study with the listed participants only."""
    keep = lambda df, by=(): align.keep_ids(df, members, by)
    return Study(
        enrollment=keep(study.enrollment),
        active=keep(study.active, ["ts"]),
        passive=keep(study.passive, ["ts"]),
        clinical=keep(study.clinical, ["ts"]),
        demographics=keep(study.demographics),
        contacts=study.contacts,
        visits=study.visits,
        phq8=study.phq8,
        rses=study.rses,
        dates=keep(study.dates),
    )


def selected(study: Study, cohort: Cohort) -> Study:
    """The participants that the cohort is about: all, or those who could have been observed for the whole window."""
    if not cohort.members_only:
        return study
    days = align.days_in_study(study.active, study.enrollment)
    return restrict(study, durable(align.cohort_members(days, cohort.horizon)))


def _people(study: Study, cohort: Cohort) -> DataFrame:
    people = study.demographics
    if not cohort.merge_categories:
        return people
    if "ETHCAT2" in people.columns:
        people = merge_ethnicity(people)
    return people.withColumn("phone_status", F.when(F.col("phone_status").isin(2, 3), 0).otherwise(F.col("phone_status")))


def _site_levels(people: DataFrame) -> list[str]:
    return sorted(row.site for row in people.select("site").distinct().collect() if row.site is not None)


def demographics_tables(study: Study, cohort: Cohort) -> dict[str, DataFrame]:
    """Description of all participants and comparison of the sites."""
    indexed = study.phq8
    people = durable(
        summary.star(
            _people(study, cohort),
            summary.baseline_max(indexed, "sum_phq8"),
            summary.contact_count(study.contacts, study.enrollment, cohort.horizon),
        )
    )
    numbers = [c for c in NUMBERS if c in people.columns]
    factors = [c for c in FACTORS if c in people.columns]
    coded = compare.code_levels(people, {c: sorted(r[0] for r in people.select(c).distinct().collect() if r[0] is not None) for c in factors if c != "site"})
    return {
        "overall_numbers": compare.table_one_continuous(people, numbers, None),
        "overall_factors": compare.table_one_categorical(people, factors, None),
        "site_numbers": compare.table_one_continuous(people, numbers, "site"),
        "site_factors": compare.table_one_categorical(people, [c for c in factors if c != "site"], "site"),
        "site_summary": describe.demographic_summary(people),
        "site_levels": describe.level_frequency(people, factors),
        "site_tests": compare.kruskal_wallis(coded, [*numbers, *[c for c in factors if c != "site"]], "site"),
        "missing": summary.null_profile(people, people.columns),
    }


def retention_tables(study: Study, cohort: Cohort) -> dict[str, DataFrame]:
    """Survival curves of the three streams and their hazard models, for the cohort's participants."""
    study = selected(study, cohort)
    people = _people(study, cohort)
    base = people.select("p_id").join(study.enrollment.select("p_id", "enrollment_date"), "p_id", "left")
    labels = retention.dropout_labels(study.active, study.passive, study.enrollment, base, cohort)
    contacts = summary.contact_count(study.contacts, study.enrollment, cohort.horizon) if cohort.with_contacts else None
    baseline = summary.baseline_first(study.phq8, "sum_phq8", ("total_time_taken",))
    table = durable(retention.model_covariates(retention.survival_cohort(people, study.enrollment, labels, contacts, baseline)))
    curve = survival.km_curve(survival.dropout_long(table, STREAMS))
    sites = _site_levels(people)
    terms = retention.model_terms(table.columns, sites, numeric_phone_status=cohort.numeric_phone_status)
    fit = cox.coxph(retention.long_matrix(table, terms), terms, model="stream")
    results = {
        "curves": survival.km_confidence(curve),
        "medians": survival.km_median(curve),
        "age_by_employment": compare.chi_square(compare.contingency(table, "age_band", "employment_cat"), [], "age_band", "employment_cat"),
        "hazard_ratios": report.hazard_ratio_report(fit.coefficients()),
        "forest": fit.forest(),
        "model_summary": fit.summary().join(fit.concordance(), "model"),
        "proportionality": fit.ph_test(),
    }
    for stream, (_, column) in cohort.episodes.items():
        if column in table.columns:
            episodes = retention.episode_model(table, cohort, stream, sites)
            results[f"episodes_{stream}"] = report.hazard_ratio_report(episodes.coefficients())
            results[f"episodes_{stream}_proportionality"] = episodes.ph_test()
            results[f"episodes_{stream}_residuals"] = episodes.schoenfeld()
    return results


def _record_counts(study: Study, cohort: Cohort) -> DataFrame:
    """Value counts of the survey and visit records per participant."""
    def minutes(df: DataFrame, prefix: str, score) -> DataFrame:
        return describe.melt(
            df.select("p_id", score.alias(f"{prefix}_score"), (F.col("response_lag") / 60.0).alias(f"{prefix}_response_min"),
                      F.col("total_time_taken").alias(f"{prefix}_total_s")),
            ["p_id"], [f"{prefix}_score", f"{prefix}_response_min", f"{prefix}_total_s"],
        )

    visits = summary.visits_in_period(study.visits, study.enrollment, cohort.horizon)
    rows = (
        minutes(study.phq8, "phq8", F.col("sum_phq8"))
        .unionByName(minutes(study.rses, "rses", drop_above("sum_rses", RSES_MAX)))
        .unionByName(describe.melt(visits, ["p_id"], ["ids_score"]))
    )
    return ranks.value_counts(rows, ["p_id", "variable"])


def _with_baseline(shared: DataFrame, stream: str) -> DataFrame:
    """Baseline scores as the stream's profile takes them."""
    scores = ("sum_phq8", "sum_rses")
    if stream in engagement.KNOWN_BASELINE:
        shared = shared.withColumns({score: F.col(f"known_{score}") for score in scores})
    return shared.drop(*[f"known_{score}" for score in scores])


def engagement_tables(study: Study, cohort: Cohort, seed: int = 1, k_max: int = 10) -> dict[str, DataFrame]:
    """k-means clusters of each stream, their comparison tables and the plot data over all streams, for the cohort's participants."""
    study = selected(study, cohort)
    people = _people(study, cohort)
    wide = durable(engagement.all_stream_words(study.active, study.passive, study.enrollment, people, cohort))
    shared = durable(
        summary.star(
            people,
            summary.contact_count(study.contacts, study.enrollment, cohort.horizon),
            summary.visit_summary(study.visits, study.enrollment, cohort.horizon),
            *engagement.survey_summaries(study.phq8, study.rses, cohort),
            summary.baseline_max(study.phq8, "sum_phq8"),
            summary.baseline_max(study.rses, "sum_rses"),
            *[summary.baseline_top1(records, score).withColumnRenamed(score, f"known_{score}") for records, score in ((study.phq8, "sum_phq8"), (study.rses, "sum_rses"))],
        ).withColumn("total_time", F.col("phq8_total_s") + F.col("rses_total_s"))
    )
    records = durable(_record_counts(study, cohort))
    numbers = [c for c in NUMBERS if c in [*shared.columns, "engaged_days"]]
    factors = [c for c in FACTORS if c in shared.columns]
    results, profiles = {}, {}
    all_bins = {stream: engagement.bins_of(cohort, stream) for stream in STREAMS}
    rows = durable(patterns.stream_rows(wide, all_bins))
    weighted = patterns.weighted_patterns(rows)
    fits = lloyd.fit_all(weighted, all_bins, range(1, max(k_max, cohort.clusters) + 1), seed=seed)
    best = lloyd.best(fits)
    curve = lloyd.curve(weighted, [f for f in fits if f.k <= k_max])
    placed_all = durable(lloyd.assign(rows, {s: best[s, cohort.clusters] for s in STREAMS if (s, cohort.clusters) in best}, all_bins).drop("raw_cluster"))
    for stream, bins in all_bins.items():
        names = grid.word_names(bins, f"{stream}_w")
        words = wide.select("p_id", *[F.col(a).alias(b) for a, b in zip(names, grid.word_names(bins))])
        placed = placed_all.filter(F.col("stream") == stream).drop("stream")
        days = grid.count_bits(grid.word_names(bins)) * F.lit(14 if stream == "active" else 1)
        profile = durable(placed.join(words.select("p_id", days.alias("engaged_days")), "p_id").join(_with_baseline(shared, stream), "p_id", "left"))
        members = profile.select("p_id", "cluster")
        spread = hot_join(records, members.withColumnRenamed("cluster", "stratum"), ["p_id"], "inner", ["variable", "value"])
        by_record = spread.groupBy("variable", "stratum", "value").agg(F.sum("n").alias("n"))
        by_record = durable(by_record)
        rate = words.join(members, "p_id").select("cluster", F.lit(bins).alias("bins"), grid.active_bins(grid.word_names(bins), bins).alias("active"))
        results |= {
            f"{stream}_wss": curve.filter(F.col("stream") == stream).select("k", "wss"),
            f"{stream}_members": members,
            f"{stream}_bin_rate": cluster.bin_rate(rate, ["cluster"]),
            f"{stream}_comparison": _comparison(profile, by_record, numbers, factors),
        }
        profiles[STREAM_LABELS[stream]] = profile
    columns = ["p_id", "cluster", "age", "sum_phq8", "mean_phq8_score", "phq8_response_min", "phq8_total_s", "total_time", "engaged_days"]
    stacked = durable(cluster.stack_streams(profiles, columns))
    long = describe.melt(stacked, ["cat", "cluster"], ["sum_phq8", "phq8_response_min", "phq8_total_s", "age"])
    return {
        **results,
        "streams": stacked,
        "boxplots": describe.boxplot_stats(long, ["variable", "cat", "cluster"], bucket_by="variable"),
        "whisker_limits": describe.whisker_limits(long, ["variable"], bucket_by="variable"),
    }


def _comparison(profile: DataFrame, records: DataFrame, numbers: list[str], factors: list[str]) -> DataFrame:
    """The stacked cluster comparison: participants, longitudinal records, categories."""
    counts = durable(ranks.value_counts(describe.melt(profile.withColumnRenamed("cluster", "stratum"), ["stratum"], numbers), ["variable", "stratum"]))
    categories = compare.table_one_categorical(profile, factors, "cluster")
    tests = compare.chi_square(categories.select("variable", "level", "stratum", "n"), ["variable"], "level", "stratum").select("variable", "p")
    for part in (counts, records):
        tests = tests.unionByName(compare.kruskal_from_counts(part.filter(F.col("value").isNotNull()), "stratum").select("variable", "p"))
    sections = [
        ("participants", [c for c in numbers if c not in ("sum_phq8", "sum_rses", "count_ids", "baseline_ids")] + factors),
        ("depression", ["sum_phq8", "phq8_score", "phq8_response_min", "phq8_total_s"]),
        ("self-esteem", ["sum_rses", "rses_score", "rses_response_min", "rses_total_s"]),
        ("clinical", ["baseline_ids", "count_ids", "ids_score"]),
    ]
    continuous = compare.quantile_table(counts).unionByName(compare.quantile_table(records))
    return compare.comparison_report(continuous, categories, tests, sections)


def write_results(results: dict[str, DataFrame], folder: str) -> None:
    """One CSV folder per table; member lists as plain id lists."""
    for name, table in results.items():
        if name.startswith("members_"):
            write_id_list(table, f"{folder}/{name}.tsv")
        else:
            write_csv(table, f"{folder}/{name}")
