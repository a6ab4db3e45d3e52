"""DuckDB SQL for the queries, written independently of the Spark operators.

Every text starts with the fixture tables and helper tables it needs as CTEs.
Whole numbers are cast to bigint and other numbers rounded as in the queries.
"""

from __future__ import annotations

import re

from oracle.fixtures import FIXTURES

STREAMS = ("active", "phone", "fitbit")
ENDS = {"cohort_1": (301, 329), "cohort_2": (660, 688)}


def _last(events: str, enrollment: str, horizon: int, grace: int) -> str:
    return f"""SELECT p_id, stream,
 max(ts) FILTER (WHERE ts <= CAST(enrollment_date AS TIMESTAMP) + INTERVAL {horizon} DAY) AS last_h,
 max(ts) FILTER (WHERE ts <= CAST(enrollment_date AS TIMESTAMP) + INTERVAL {grace} DAY) AS last_grace
 FROM {events} JOIN {enrollment} USING (p_id) GROUP BY p_id, stream"""


def _labels(base: str, last: str, horizon: int, active_offset: int) -> str:
    off = f"CASE WHEN s.stream = 'active' THEN {active_offset} ELSE 0 END"
    return f"""SELECT b.p_id, s.stream,
 coalesce(date_diff('day', b.enrollment_date, CAST(l.last_h AS DATE)) + {off}, 0) AS duration,
 CASE WHEN coalesce(date_diff('day', b.enrollment_date, CAST(l.last_grace AS DATE)) + {off}, 0) < {horizon} THEN 1 ELSE 0 END AS event
 FROM {base} b CROSS JOIN (SELECT unnest(['active', 'phone', 'fitbit']) AS stream) s
 LEFT JOIN {last} l ON l.p_id = b.p_id AND l.stream = s.stream"""


def _km(labels: str, by: str) -> str:
    return f"""SELECT {by}, time, n_risk, n_event, n_censor,
 product(1.0 - CAST(n_event AS DOUBLE) / n_risk) OVER (PARTITION BY {by} ORDER BY time) AS surv
 FROM (SELECT {by}, time, n_event, n_censor, sum(n_event + n_censor) OVER (PARTITION BY {by} ORDER BY time DESC) AS n_risk
  FROM (SELECT {by}, duration AS time, sum(event) AS n_event, sum(1 - event) AS n_censor FROM {labels} GROUP BY {by}, duration))"""


def _clusters(stream: str) -> str:
    return f"""SELECT p.p_id, coalesce(e.engaged, 0) AS engaged,
 CASE WHEN e.engaged >= 3 THEN 'C1' WHEN e.engaged >= 2 THEN 'C2' WHEN e.engaged >= 1 THEN 'C3' ELSE 'C4' END AS cluster
 FROM participants p LEFT JOIN (SELECT p_id, count(DISTINCT bin) AS engaged FROM bins_{stream} GROUP BY p_id) e USING (p_id)"""


def _day_bins(data_name: str) -> str:
    return f"""SELECT p_id, date_diff('day', enrollment_date, CAST(ts AS DATE)) + 1 AS bin
 FROM fx_passive JOIN fx_enrollment USING (p_id) WHERE data_name = '{data_name}'
 AND date_diff('day', enrollment_date, CAST(ts AS DATE)) + 1 BETWEEN 1 AND 301"""


def _biweek_bins(horizon: int) -> str:
    return f"""SELECT p_id, CAST(floor(date_diff('day', enrollment_date, CAST(ts AS DATE)) / 14.0) AS BIGINT) + 1 AS bin
 FROM fx_active JOIN fx_enrollment USING (p_id) WHERE data_name IN ('PHQ8', 'RSES')
 AND date_diff('day', enrollment_date, CAST(ts AS DATE)) + 1 BETWEEN 1 AND {horizon}"""


def _survey_summary(horizon: int, statistic: str) -> str:
    whole = "count(*) = count({0})"
    def strict(agg: str, col: str) -> str:
        return f"CASE WHEN {whole.format(col)} THEN {agg}({col}) END"
    return f"""SELECT p_id, {strict(statistic, 'sum_phq8')} AS mean_phq8_score, {strict('median', 'response_lag')} / 60.0 AS phq8_response_min,
 {strict('median', 'total_time_taken')} AS phq8_total_s, {strict('avg', 'sum_rses')} AS mean_rses_score
 FROM surveys WHERE days <= {horizon} GROUP BY p_id"""


_ILL = " + ".join(f"ill_{i}" for i in range(19))
_AGE = "CASE WHEN age <= 29 THEN '<30' WHEN age <= 39 THEN '30-39' WHEN age <= 49 THEN '40-49' WHEN age <= 59 THEN '50-59'"

HELPERS = {
    **FIXTURES,
    "star": f"""SELECT d.p_id, age, sex, site, marry_align, edu_age_align,
 CASE WHEN brand_code = 1 THEN 'Samsung' WHEN brand_code = 4 THEN 'Motorola' WHEN brand_code BETWEEN 2 AND 8 THEN 'Other'
  ELSE CAST(brand_code AS VARCHAR) END AS phone_brand,
 CASE WHEN employment_status IN ('Employed', 'Furloughed') THEN 'Yes'
  WHEN employment_status IN ('Unemployed', 'Off sick', 'Student', 'Retired') THEN 'No' ELSE 'Not reported' END AS employment,
 CASE WHEN phone_status = 3 THEN 0 ELSE phone_status END AS phone_status, comorb_sum,
 CASE WHEN comorb_sum > 0 THEN 1 WHEN comorb_sum = 0 THEN 0 END AS comorb
 FROM fx_demog d LEFT JOIN (SELECT p_id, {_ILL} AS comorb_sum FROM fx_comorbidity) c ON d.p_id = c.p_id""",
    "outside": "SELECT p_id FROM fx_active EXCEPT SELECT p_id FROM fx_enrollment",
    "people": "SELECT * FROM star WHERE p_id NOT IN (SELECT p_id FROM outside)",
    "participants": "SELECT p_id FROM fx_demog WHERE p_id NOT IN (SELECT p_id FROM outside)",
    "stream_events": """SELECT p_id, 'active' AS stream, ts FROM fx_active UNION ALL
 SELECT p_id, CASE data_name WHEN 'Passive_phone' THEN 'phone' ELSE 'fitbit' END, ts FROM fx_passive
 WHERE data_name IN ('Passive_phone', 'Passive_Fitbit')""",
    "ev_events": "SELECT p_id, data_name AS stream, ts FROM fx_ev_stream",
    "last_cohort_1": _last("stream_events", "fx_enrollment", 301, 329),
    "last_cohort_2": _last("stream_events", "fx_enrollment", 660, 688),
    "last_subday": _last("ev_events", "fx_ev_enrollment", 14, 21),
    "enrolled_2": "SELECT p_id, enrollment_date FROM fx_enrollment WHERE p_id IN (SELECT p_id FROM members_2)",
    "base_people": "SELECT p.p_id, e.enrollment_date FROM people p LEFT JOIN fx_enrollment e USING (p_id)",
    "labels_1": _labels("fx_enrollment", "last_cohort_1", 301, 0),
    "labels_2": _labels("enrolled_2", "last_cohort_2", 660, 1),
    "labels_people": _labels("base_people", "last_cohort_1", 301, 0),
    "last_day": "SELECT max(CAST(ts AS DATE)) AS last_day FROM fx_active JOIN fx_enrollment USING (p_id)",
    "study_days": """SELECT p_id, 'theoretical_max' AS type, date_diff('day', enrollment_date, (SELECT last_day FROM last_day)) + 1 AS value
 FROM fx_enrollment UNION ALL
 SELECT e.p_id, 'actual_days', coalesce(date_diff('day', e.enrollment_date, max(CAST(a.ts AS DATE))) + 1, 1)
 FROM fx_enrollment e LEFT JOIN fx_active a USING (p_id) GROUP BY e.p_id, e.enrollment_date""",
    "members_2": "SELECT DISTINCT p_id FROM study_days WHERE type = 'theoretical_max' AND value >= 660",
    "surveys": """SELECT s.p_id, s.l_orderkey, s.start_time, nullif(notif_lag_s, -1) AS response_lag, total_time_taken,
 s_1 + s_2 + s_3 + s_4 + s_5 + s_6 + s_7 + s_8 AS sum_phq8,
 s_1 + (3 - s_2) + s_3 + s_4 + (3 - s_5) + (3 - s_6) + s_7 + (3 - s_8) + (3 - s_9) + s_10 AS sum_rses,
 date_diff('day', e.enrollment_date, CAST(s.start_time AS DATE)) + 1 AS days, e.enrollment_date,
 floor((date_diff('day', e.enrollment_date, CAST(s.start_time AS DATE)) + 1) / 7.0) + 1 AS week
 FROM fx_survey s LEFT JOIN fx_enrollment e USING (p_id)""",
    "baseline": """SELECT p_id, sum_phq8 FROM (SELECT p_id, sum_phq8,
 row_number() OVER (PARTITION BY p_id ORDER BY start_time, total_time_taken, sum_phq8) AS rn FROM surveys) WHERE rn = 1""",
    "early": "SELECT * FROM surveys WHERE week IN (1, 2) AND enrollment_date IS NOT NULL",
    "base_max": """SELECT p_id, CASE WHEN count(*) = count(sum_phq8) THEN max(sum_phq8) END AS sum_phq8,
 CASE WHEN count(*) = count(sum_rses) THEN max(sum_rses) END AS sum_rses FROM early GROUP BY p_id""",
    "contacts_1": """SELECT c.p_id, max(record_num) AS num_contact FROM fx_contact c JOIN fx_enrollment e USING (p_id)
 WHERE date_diff('day', enrollment_date, date) + 1 <= 301 GROUP BY c.p_id""",
    "visits_1": """SELECT v.* FROM fx_ids v JOIN fx_enrollment e USING (p_id)
 WHERE date_diff('day', enrollment_date, date) + 1 <= 301 OR record_num = 0""",
    "visit_sum": """SELECT p_id, count(*) AS count_ids, max(ids_score) FILTER (WHERE record_num = 0) AS baseline_ids
 FROM visits_1 GROUP BY p_id""",
    "survey_sum": _survey_summary(301, "median"),
    "bins_active": _biweek_bins(301),
    "bins_phone": _day_bins("Passive_phone"),
    "bins_fitbit": _day_bins("Passive_Fitbit"),
    **{f"clusters_{s}": _clusters(s) for s in STREAMS},
    "profile": "\n UNION ALL ".join(
        f"""SELECT '{s}' AS stream, c.p_id, c.cluster, c.engaged, p.age, p.sex, p.site, p.employment, p.phone_brand, p.phone_status, p.comorb, p.marry_align,
 num_contact, count_ids, baseline_ids, mean_phq8_score, phq8_response_min, phq8_total_s, mean_rses_score, b.sum_phq8
 FROM clusters_{s} c LEFT JOIN people p ON p.p_id = c.p_id LEFT JOIN contacts_1 n ON n.p_id = c.p_id
 LEFT JOIN visit_sum v ON v.p_id = c.p_id LEFT JOIN survey_sum s ON s.p_id = c.p_id LEFT JOIN {'base_known' if s == 'phone' else 'base_max'} b ON b.p_id = c.p_id"""
        for s in STREAMS
    ),
    "placed": " UNION ALL ".join(f"SELECT '{s}' AS stream, p_id, cluster FROM clusters_{s}" for s in STREAMS),
    "rses_sum": """SELECT p_id, CASE WHEN count(*) = count(sum_rses) THEN avg(sum_rses) END AS mean_rses_score,
 CASE WHEN count(*) = count(response_lag) THEN median(response_lag) END / 60.0 AS rses_response_min,
 CASE WHEN count(*) = count(total_time_taken) THEN median(total_time_taken) END AS rses_total_s
 FROM surveys WHERE days <= 301 AND l_orderkey % 3 = 1 GROUP BY p_id""",
    "base_known": "SELECT p_id, max(sum_phq8) AS sum_phq8 FROM early WHERE sum_phq8 IS NOT NULL GROUP BY p_id",
    "streams_all": "\n UNION ALL ".join(
        f"""SELECT '{label}' AS cat, c.p_id, c.cluster, p.age, c.engaged * {days} AS engaged_days, s.mean_phq8_score, s.phq8_response_min,
 s.phq8_total_s, s.phq8_total_s + r.rses_total_s AS total_time, b.sum_phq8
 FROM clusters_{s} c LEFT JOIN people p ON p.p_id = c.p_id LEFT JOIN survey_sum s ON s.p_id = c.p_id
 LEFT JOIN rses_sum r ON r.p_id = c.p_id LEFT JOIN {'base_known' if s == 'phone' else 'base_max'} b ON b.p_id = c.p_id"""
        for s, label, days in (("active", "Phone-Active", 14), ("phone", "Phone-Passive", 1), ("fitbit", "Fitbit-Passive", 1))
    ),
    "km_1": _km("labels_1", "stream"),
    "cohort_table": f"""SELECT p.p_id, {_AGE} WHEN age IS NOT NULL THEN '>60' END AS age_band, sex, age,
 CASE marry_align WHEN 'HOUSEHOLD' THEN 'Married' WHEN 'BUILDING' THEN 'Married' WHEN 'MACHINERY' THEN 'Single' WHEN 'AUTOMOBILE' THEN 'Single' END AS marry_cat,
 CASE WHEN employment IN ('Yes', 'No') THEN employment END AS employment_cat, edu_age_align, b.sum_phq8 AS phq_base,
 CASE WHEN b.sum_phq8 >= 20 THEN 'severe' WHEN b.sum_phq8 >= 15 THEN 'moderately severe' WHEN b.sum_phq8 >= 10 THEN 'moderate'
  WHEN b.sum_phq8 >= 5 THEN 'mild' WHEN b.sum_phq8 >= 0 THEN 'no depressive symptoms' END AS phq_band,
 comorb, site, phone_brand, CASE WHEN phone_status = 1 THEN 1 ELSE 0 END AS phone_status_cat, num_contact,
 {', '.join(f"max(l.{k}) FILTER (WHERE l.stream = '{s}') AS {k}_{s}" for s in STREAMS for k in ('duration', 'event'))}
 FROM people p LEFT JOIN labels_people l ON l.p_id = p.p_id LEFT JOIN baseline b ON b.p_id = p.p_id LEFT JOIN contacts_1 c ON c.p_id = p.p_id
 GROUP BY ALL""",
    "records": """SELECT p_id, unnest(['sum_phq8', 'sum_rses', 'response_lag_min', 'total_time_taken']) AS variable,
 unnest([CAST(sum_phq8 AS DOUBLE), CASE WHEN sum_rses <= 20 THEN sum_rses END, response_lag / 60.0, total_time_taken]) AS value FROM surveys
 UNION ALL SELECT p_id, 'ids_score', ids_score FROM visits_1""",
}

_ORDER = list(HELPERS)


def _needed(text: str, found: set[str]) -> None:
    for name in HELPERS:
        if name not in found and re.search(rf"\b{name}\b", text):
            found.add(name)
            _needed(HELPERS[name], found)


def _topological(names: set[str]) -> list[str]:
    placed: list[str] = []

    def place(name: str) -> None:
        if name in placed:
            return
        for other in _ORDER:
            if other in names and other != name and re.search(rf"\b{other}\b", HELPERS[name]):
                place(other)
        placed.append(name)

    for name in _ORDER:
        if name in names:
            place(name)
    return placed


def _sql(text: str) -> str:
    """``text`` with the CTEs it refers to, in dependency order."""
    found: set[str] = set()
    _needed(text, found)
    parts = [f"{name} AS ({HELPERS[name].strip()})" for name in _topological(found)]
    return f"WITH {', '.join(parts)} {text.strip()}" if parts else text.strip()


def _r(expression: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({expression} AS DOUBLE), {digits}) AS {name}"


def _i(*names: str) -> str:
    return ", ".join(f"CAST({name} AS BIGINT) AS {name}" for name in names)


def _summary_columns() -> str:
    return ", ".join(_r(n, n) for n in ("mean_phq8_score", "phq8_response_min", "phq8_total_s", "mean_rses_score"))


def _unpivot(source: str, keys: str, columns: list[str], kind: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}, '{c}' AS variable, CAST({c} AS {kind}) AS value FROM {source}" for c in columns
    )


def _quartiles(source: str, keys: str) -> str:
    return f"""SELECT {keys}, CAST(count(value) AS BIGINT) AS n, CAST(count(*) - count(value) AS BIGINT) AS n_missing,
 {_r('quantile_cont(value, 0.25)', 'q1')}, {_r('quantile_cont(value, 0.5)', 'median')}, {_r('quantile_cont(value, 0.75)', 'q3')}
 FROM ({source}) GROUP BY {keys}"""


def _categorical(source: str, stratum: str, columns: list[str], by: str = "") -> str:
    long = _unpivot(source, f"{by}{stratum} AS stratum", columns, "VARCHAR")
    return f"""SELECT {by}variable, value AS level, stratum, CAST(count(*) AS BIGINT) AS n,
 round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY {by}variable, stratum), 6) AS pct
 FROM ({long}) WHERE value IS NOT NULL GROUP BY {by}variable, value, stratum"""


def _tail(statistic: str, df: str) -> str:
    """Upper tail of the chi-square distribution by the series of the incomplete gamma function; nothing is left beyond 400."""
    terms = f"[exp(({df} / 2.0 + n) * ln({statistic} / 2) - {statistic} / 2 - lgamma({df} / 2.0 + n + 1)) FOR n IN range(0, 600)]"
    return f"CASE WHEN {statistic} > 400 THEN 0.0 WHEN {statistic} <= 0 THEN 1.0 ELSE 1.0 - list_sum({terms}) END"


def _report() -> str:
    """Medians, levels and tests of the profile and of the records, each worked out on single rows."""
    names = "CASE variable WHEN 'sum_phq8' THEN 'record_phq8' WHEN 'sum_rses' THEN 'record_rses' WHEN 'ids_score' THEN 'record_ids' ELSE variable END"
    numbers = f"{_unpivot('profile', 'stream, cluster AS stratum', _NUMBERS, 'DOUBLE')} UNION ALL SELECT stream, cluster, {names}, value FROM records JOIN placed USING (p_id)"
    ranked = """SELECT stream, variable, stratum, CAST(count(*) OVER v AS DOUBLE) AS total, CAST(count(*) OVER (PARTITION BY stream, variable, value) AS DOUBLE) AS tied,
   rank() OVER (PARTITION BY stream, variable ORDER BY value) + (count(*) OVER (PARTITION BY stream, variable, value) - 1) / 2.0 AS rank
   FROM numbers WHERE value IS NOT NULL WINDOW v AS (PARTITION BY stream, variable)"""
    places = {v: (section, i + 1) for i, (section, v) in enumerate((section, v) for section, variables in _SECTIONS for v in variables)}
    listed = ", ".join(f"('{v}', '{section}', {i})" for v, (section, i) in places.items())
    return f"""WITH numbers(stream, stratum, variable, value) AS ({numbers}),
  quartiles AS (SELECT stream, variable, stratum, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM numbers GROUP BY ALL),
  sums AS (SELECT stream, variable, stratum, sum(rank) AS r, count(*) AS n, any_value(total) AS total, sum(tied * tied - 1) AS ties FROM ({ranked}) GROUP BY ALL),
  kruskal AS (SELECT stream, variable, count(*) - 1 AS df,
   (12.0 / (any_value(total) * (any_value(total) + 1)) * sum(r * r / n) - 3.0 * (any_value(total) + 1)) / nullif(1.0 - sum(ties) / nullif(pow(any_value(total), 3) - any_value(total), 0), 0) AS h
   FROM sums GROUP BY stream, variable),
  levels AS (SELECT stream, variable, level, stratum, n, pct FROM ({_categorical('profile', 'cluster', _FACTORS, 'stream, ')})),
  rows_ AS (SELECT stream, variable, level, sum(n) AS n FROM levels GROUP BY ALL),
  columns_ AS (SELECT stream, variable, stratum, sum(n) AS n FROM levels GROUP BY ALL),
  expected AS (SELECT r.stream, r.variable, r.level, c.stratum, CAST(r.n AS DOUBLE) * c.n / sum(r.n) OVER (PARTITION BY r.stream, r.variable, c.stratum) AS e
   FROM rows_ r JOIN columns_ c ON c.stream = r.stream AND c.variable = r.variable),
  chi AS (SELECT stream, variable, (count(DISTINCT level) - 1) * (count(DISTINCT stratum) - 1) AS df, sum(pow(coalesce(n, 0) - e, 2) / e) AS h
   FROM expected LEFT JOIN levels USING (stream, variable, level, stratum) GROUP BY stream, variable),
  tests AS (SELECT stream, variable, {_tail('h', 'df')} AS p FROM (SELECT * FROM kruskal UNION ALL SELECT * FROM chi)),
  texts AS (SELECT stream, variable, NULL AS level, stratum,
    printf('%.2f', round_even(q2, 2)) || ' [' || printf('%.2f', round_even(q1, 2)) || ', ' || printf('%.2f', round_even(q3, 2)) || ']' AS text FROM quartiles
   UNION ALL SELECT stream, variable, level, stratum, CAST(n AS VARCHAR) || ' (' || printf('%.1f', round_even(pct, 1)) || ')' FROM levels)
  SELECT stream, section, CAST(ord AS BIGINT) AS ord, variable, level, stratum, text, CASE WHEN p < 0.001 THEN '<0.001' ELSE printf('%.3f', round_even(p, 3)) END AS p_text
  FROM texts JOIN (VALUES {listed}) o(variable, section, ord) USING (variable) LEFT JOIN tests USING (stream, variable)"""


_KRUSKAL_SOURCE = " UNION ALL ".join(
    f"SELECT '{name}' AS variable, site, CAST({expr} AS DOUBLE) AS value FROM people"
    for name, expr in {
        "age": "age",
        "edu_age_align": "edu_age_align",
        "comorb_sum": "comorb_sum",
        "phone_status": "phone_status",
        "sex": "CASE sex WHEN 'female' THEN 1 WHEN 'male' THEN 2 END",
        "employment": "CASE employment WHEN 'No' THEN 1 WHEN 'Not reported' THEN 2 WHEN 'Yes' THEN 3 END",
    }.items()
)
_KRUSKAL = f"""SELECT variable, CAST(n AS BIGINT) AS n, CAST(g - 1 AS BIGINT) AS df, round(h, 6) AS h,
 round(exp(-h / 2) * (1 + h / 2), 6) AS p
 FROM (SELECT variable, any_value(total) AS n, count(*) AS g,
  (12.0 / (any_value(total) * (any_value(total) + 1.0)) * sum(r * r / n) - 3.0 * (any_value(total) + 1)) / (1.0 - any_value(ties)) AS h
  FROM (SELECT variable, site, sum(rank) AS r, count(*) AS n, any_value(total) AS total,
   any_value(ties) AS ties
   FROM (SELECT a.variable, a.site, rank() OVER (PARTITION BY a.variable ORDER BY a.value)
     + (count(*) OVER (PARTITION BY a.variable, a.value) - 1) / 2.0 AS rank,
     CAST(count(*) OVER (PARTITION BY a.variable) AS DOUBLE) AS total, t.ties
    FROM ({_KRUSKAL_SOURCE}) a
    JOIN (SELECT variable, sum(c * c * c - c) / (pow(sum(c), 3) - sum(c)) AS ties
      FROM (SELECT variable, value, CAST(count(*) AS DOUBLE) AS c FROM ({_KRUSKAL_SOURCE}) WHERE value IS NOT NULL GROUP BY variable, value)
      GROUP BY variable) t ON t.variable = a.variable
    WHERE a.value IS NOT NULL)
   GROUP BY variable, site)
  GROUP BY variable)"""


def _episodes(labels: str, stream: str, cuts: tuple[int, ...]) -> str:
    low = [-1, *cuts]
    high = [*cuts, None]
    rows = []
    for i, (a, b) in enumerate(zip(low, high)):
        stop = "duration" if b is None else f"least(duration, {b})"
        start = f"least({a}, duration - 1)" if i == 0 else str(a)
        where = "" if i == 0 else f" AND duration > {a}"
        rows.append(
            f"SELECT p_id, CAST({i + 1} AS BIGINT) AS tgroup, CAST({start} AS BIGINT) AS tstart, CAST({stop} AS BIGINT) AS tstop,"
            f" CAST(CASE WHEN {stop} = duration THEN event ELSE 0 END AS BIGINT) AS event FROM {labels} WHERE stream = '{stream}'{where}"
        )
    return " UNION ALL ".join(rows)


_DESIGN = [
    *[f"age_band = '{v}'" for v in ("30-39", "40-49", "50-59", ">60")],
    "sex = 'male'", "marry_cat = 'Married'", "employment_cat = 'Yes'", "edu_age_align", "phq_base", "comorb = 1",
    *[f"site = '{v}'" for v in ("AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")],
    "phone_brand = 'Motorola'", "phone_brand = 'Samsung'", "phone_status_cat = 1",
]
_COMPLETE = """age_band IS NOT NULL AND sex IS NOT NULL AND marry_cat IS NOT NULL AND employment_cat IS NOT NULL AND edu_age_align IS NOT NULL
 AND phq_base IS NOT NULL AND comorb IS NOT NULL AND site IS NOT NULL AND phone_brand IN ('Other', 'Motorola', 'Samsung')"""

_BOX_SOURCE = _unpivot("streams_all", "cat, cluster", ["age", "sum_phq8", "phq8_response_min", "phq8_total_s"], "DOUBLE")
_WHISKER_SOURCE = _unpivot("streams_all", "1 AS one", ["phq8_response_min", "phq8_total_s"], "DOUBLE")
_LEVEL_SOURCE = " UNION ALL ".join(
    f"SELECT '{name}' AS variable, site, CAST({expr} AS VARCHAR) AS level FROM fx_demog"
    for name, expr in {
        "sex": "sex",
        "marry_align": "marry_align",
        "phone_status": "phone_status",
        "employment": "CASE WHEN employment_status IN ('Employed', 'Furloughed') THEN 'Yes'"
        " WHEN employment_status IN ('Unemployed', 'Off sick', 'Student', 'Retired') THEN 'No' ELSE 'Not reported' END",
    }.items()
)
_NUMBERS = ["age", "engaged", "num_contact", "count_ids", "baseline_ids", "mean_phq8_score", "phq8_response_min", "phq8_total_s", "mean_rses_score", "sum_phq8"]
_FACTORS = ["sex", "site", "employment", "phone_brand", "phone_status", "comorb", "marry_align"]
_SECTIONS = [
    ("participants", ["age", *_FACTORS, "num_contact", "engaged"]),
    ("depression", ["sum_phq8", "mean_phq8_score", "record_phq8", "response_lag_min", "total_time_taken"]),
    ("self-esteem", ["mean_rses_score", "record_rses"]),
    ("clinical", ["baseline_ids", "count_ids", "record_ids"]),
]
_PEOPLE_NULLS = ["p_id", "age", "sex", "site", "phone_brand", "employment", "comorb_sum", "comorb", "phone_status", "enrollment_date", "withdrawal_date"]


def _grid(bins: str, horizon: int) -> str:
    return f"""SELECT p.p_id, CAST(g.bin AS BIGINT) AS bin, CAST(CASE WHEN b.bin IS NULL THEN 0 ELSE 1 END AS BIGINT) AS active
 FROM participants p CROSS JOIN (SELECT unnest(range(1, {horizon + 1})) AS bin) g
 LEFT JOIN (SELECT DISTINCT p_id, bin FROM {bins}) b ON b.p_id = p.p_id AND b.bin = g.bin"""


def _vector(horizon: int, bins: int, members: str) -> str:
    return f"""SELECT p.p_id, string_agg(CASE WHEN b.bin IS NULL THEN '0' ELSE '1' END, '' ORDER BY g.bin) AS vec
 FROM (SELECT p_id FROM participants {members}) p CROSS JOIN (SELECT unnest(range(1, {bins + 1})) AS bin) g
 LEFT JOIN (SELECT DISTINCT p_id, bin FROM ({_biweek_bins(horizon)})) b ON b.p_id = p.p_id AND b.bin = g.bin GROUP BY p.p_id"""


def _subday_daily() -> str:
    return """SELECT p_id, data_name, date_diff('day', enrollment_date, CAST(ts AS DATE)) + 1 AS day_in_study, count(*) AS n
 FROM fx_ev_stream JOIN fx_ev_enrollment USING (p_id)
 WHERE date_diff('day', enrollment_date, CAST(ts AS DATE)) + 1 BETWEEN 1 AND 14 GROUP BY ALL"""


_KM_OUT = f"stream, {_i('time', 'n_risk', 'n_event', 'n_censor')}, round(surv, 6) AS surv"
_SUBDAY_LABELS = """(SELECT e.p_id, 'app' AS stream, coalesce(date_diff('day', e.enrollment_date, CAST(max(v.ts) FILTER (
  WHERE v.ts <= CAST(e.enrollment_date AS TIMESTAMP) + INTERVAL 14 DAY) AS DATE)), 0) AS duration,
 CASE WHEN coalesce(date_diff('day', e.enrollment_date, CAST(max(v.ts) FILTER (
  WHERE v.ts <= CAST(e.enrollment_date AS TIMESTAMP) + INTERVAL 21 DAY) AS DATE)), 0) < 14 THEN 1 ELSE 0 END AS event
 FROM fx_ev_enrollment e LEFT JOIN fx_ev_stream v USING (p_id) GROUP BY e.p_id, e.enrollment_date)"""

# Newton steps for one 0/1 covariate: risk sets reduce to counts of men and women per day.
_STREAM_ROWS = """SELECT s.stream, CASE s.stream WHEN 'active' THEN duration_active WHEN 'phone' THEN duration_phone ELSE duration_fitbit END AS time,
   CASE s.stream WHEN 'active' THEN event_active WHEN 'phone' THEN event_phone ELSE event_fitbit END AS event, CASE WHEN sex = 'male' THEN 1 ELSE 0 END AS male
   FROM cohort_table CROSS JOIN (SELECT unnest(['active', 'phone', 'fitbit']) AS stream) s"""


def _newton(rows: str) -> str:
    """CTEs up to ``fitted``: one model per ``stream`` of ``rows``."""
    return f"""WITH RECURSIVE long AS ({rows}),
  days AS (SELECT stream, time, CAST(count(*) AS DOUBLE) AS n, CAST(sum(male) AS DOUBLE) AS m, CAST(sum(event) AS BIGINT) AS d, CAST(sum(event * male) AS DOUBLE) AS dm
   FROM long GROUP BY stream, time),
  risk AS (SELECT stream, time, d, dm, sum(n) OVER w AS n, sum(m) OVER w AS m FROM days WINDOW w AS (PARTITION BY stream ORDER BY time DESC)),
  steps AS (SELECT stream, time, n - m - (l / CAST(d AS DOUBLE)) * (d - dm) AS w0, m - (l / CAST(d AS DOUBLE)) * dm AS w1
   FROM (SELECT *, unnest(range(0, d)) AS l FROM risk WHERE d > 0)),
  sizes AS (SELECT stream, count(*) AS n, sum(event) AS n_event, CAST(sum(event * male) AS DOUBLE) AS dm FROM long GROUP BY stream),
  newton(stream, i, b) AS (SELECT DISTINCT stream, 0, CAST(0 AS DOUBLE) FROM sizes
   UNION ALL SELECT r.stream, r.i + 1, any_value(r.b) + (any_value(z.dm) - sum(w1 * exp(r.b) / (w0 + w1 * exp(r.b))))
     / sum(w1 * exp(r.b) / (w0 + w1 * exp(r.b)) * (1 - w1 * exp(r.b) / (w0 + w1 * exp(r.b))))
   FROM newton r JOIN steps t ON t.stream = r.stream JOIN sizes z ON z.stream = r.stream WHERE r.i < 12 GROUP BY r.stream, r.i),
  fitted AS (SELECT stream, b FROM newton WHERE i = 12)"""


def _concordance(rows: str) -> str:
    """Every comparable pair, one by one."""
    return f"""WITH scored AS ({rows})
  SELECT a.stream, CAST(sum(CASE WHEN b.risk < a.risk THEN 1 ELSE 0 END) AS DOUBLE) AS lower, CAST(sum(CASE WHEN b.risk = a.risk THEN 1 ELSE 0 END) AS DOUBLE) AS tied,
   CAST(sum(CASE WHEN b.risk > a.risk THEN 1 ELSE 0 END) AS DOUBLE) AS higher, count(*) AS pairs
  FROM scored a JOIN scored b ON a.stream = b.stream AND a.event = 1 AND (b.time > a.time OR b.time = a.time AND b.event = 0) GROUP BY a.stream"""


_ONE_COVARIATE = f"""SELECT stream, CAST(n AS BIGINT) AS n, CAST(n_event AS BIGINT) AS n_event, round(b, 5) AS coef, round(exp(b), 5) AS hr,
 round(1 / sqrt(info), 5) AS se, round(b * sqrt(info), 5) AS z, round(null_ll, 5) AS loglik_null, round(ll, 5) AS loglik
 FROM ({_newton(_STREAM_ROWS)}
  SELECT r.stream, any_value(z.n) AS n, any_value(z.n_event) AS n_event, any_value(r.b) AS b,
   sum(w1 * exp(r.b) / (w0 + w1 * exp(r.b)) * (1 - w1 * exp(r.b) / (w0 + w1 * exp(r.b)))) AS info,
   -sum(ln(w0 + w1)) AS null_ll, any_value(z.dm) * any_value(r.b) - sum(ln(w0 + w1 * exp(r.b))) AS ll
  FROM fitted r JOIN steps t ON t.stream = r.stream JOIN sizes z ON z.stream = r.stream GROUP BY r.stream)"""

_ONE_COVARIATE_FIT = _ONE_COVARIATE.replace("SELECT stream,", "SELECT stream, b, ll, null_ll,", 1)

_TREND = f"""SELECT stream, round(u * u / (i22 - i12 * i12 / i11), 5) AS chisq, CAST(1 AS BIGINT) AS df
 FROM ({_newton(_STREAM_ROWS)},
  before AS (SELECT stream, time, d, dm, coalesce(product(1.0 - d / n) OVER (PARTITION BY stream ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS s FROM risk),
  centred AS (SELECT stream, time, dm, (1 - s) - sum((1 - s) * d) OVER (PARTITION BY stream) / sum(d) OVER (PARTITION BY stream) AS g, d FROM before),
  pieces AS (SELECT t.stream, t.time, sum(w1 * exp(b) / (w0 + w1 * exp(b))) AS mean, sum(w1 * exp(b) / (w0 + w1 * exp(b)) * (1 - w1 * exp(b) / (w0 + w1 * exp(b)))) AS v
   FROM steps t JOIN fitted f ON f.stream = t.stream GROUP BY t.stream, t.time)
  SELECT p.stream, sum(g * (dm - mean)) AS u, sum(v) AS i11, sum(g * v) AS i12, sum(g * g * v) AS i22
  FROM pieces p JOIN centred c ON c.stream = p.stream AND c.time = p.time GROUP BY p.stream)"""

_EPISODE_ROWS = """SELECT CAST(e.tgroup AS VARCHAR) AS stream, e.tstop AS time, e.event, CASE WHEN d.sex = 'male' THEN 1 ELSE 0 END AS male
   FROM episodes_phone e JOIN people d ON d.p_id = e.p_id"""
_EPISODE_EFFECT = f"""SELECT 'sex=male:tgroup=' || stream AS term, round(b, 5) AS coef, round(1 / sqrt(info), 5) AS se
 FROM ({_newton(_EPISODE_ROWS)}
  SELECT r.stream, any_value(r.b) AS b, sum(w1 * exp(r.b) / (w0 + w1 * exp(r.b)) * (1 - w1 * exp(r.b) / (w0 + w1 * exp(r.b)))) AS info
  FROM fitted r JOIN steps t ON t.stream = r.stream GROUP BY r.stream)"""
HELPERS["episodes_phone"] = _episodes("labels_people", "phone", (130, 240))
_ORDER.append("episodes_phone")

_ZERO_RESIDUALS = """SELECT r.p_id, r.stream, r.time, r.age - m.age AS age, r.male - m.male AS male
 FROM (WITH long AS (SELECT p_id, s.stream, CASE s.stream WHEN 'active' THEN duration_active WHEN 'phone' THEN duration_phone ELSE duration_fitbit END AS time,
   CASE s.stream WHEN 'active' THEN event_active WHEN 'phone' THEN event_phone ELSE event_fitbit END AS event,
   age, CASE WHEN sex = 'male' THEN 1.0 ELSE 0.0 END AS male
   FROM cohort_table CROSS JOIN (SELECT unnest(['active', 'phone', 'fitbit']) AS stream) s WHERE age IS NOT NULL)
  SELECT * FROM long) r
 JOIN (WITH long AS (SELECT s.stream, CASE s.stream WHEN 'active' THEN duration_active WHEN 'phone' THEN duration_phone ELSE duration_fitbit END AS time,
   CASE s.stream WHEN 'active' THEN event_active WHEN 'phone' THEN event_phone ELSE event_fitbit END AS event,
   age, CASE WHEN sex = 'male' THEN 1.0 ELSE 0.0 END AS male
   FROM cohort_table CROSS JOIN (SELECT unnest(['active', 'phone', 'fitbit']) AS stream) s WHERE age IS NOT NULL),
  days AS (SELECT stream, time, count(*) AS n, sum(age) AS age, sum(male) AS male, CAST(sum(event) AS BIGINT) AS d,
   sum(age) FILTER (WHERE event = 1) AS age_d, sum(male) FILTER (WHERE event = 1) AS male_d FROM long GROUP BY stream, time),
  risk AS (SELECT stream, time, d, age_d, male_d, sum(n) OVER w AS n, sum(age) OVER w AS age, sum(male) OVER w AS male
   FROM days WINDOW w AS (PARTITION BY stream ORDER BY time DESC)),
  steps AS (SELECT *, unnest(range(0, d)) AS l FROM risk WHERE d > 0)
  SELECT stream, time, avg((age - l / CAST(d AS DOUBLE) * age_d) / (n - l)) AS age, avg((male - l / CAST(d AS DOUBLE) * male_d) / (n - l)) AS male
  FROM steps GROUP BY stream, time) m ON m.stream = r.stream AND m.time = r.time
 WHERE r.event = 1"""

_EPISODE_NAMES = [*[f"sex={l}:tgroup={v}" for v in (1, 2, 3) for l in ("male", "female")], "sex=male:tgroup", "sex=female:tgroup"]
_EPISODE_VALUES = {"sex=male:tgroup=1": "z1", "sex=male:tgroup=2": "z2", "sex=male:tgroup=3": "z3", "sex=male:tgroup": "z1 + z2 + z3"}


def _scaled(episode: int) -> str:
    """Coefficient of the episode plus the scaled residual, which is 0 for events of other episodes."""
    return f"""(SELECT b FROM sized WHERE stream = '{episode}') + CASE WHEN e.stream = '{episode}' THEN (SELECT n FROM total) / (SELECT info FROM sized WHERE stream = '{episode}') * (e.male - m.mean) ELSE 0 END"""


_EPISODE_SCALED = f"""{_newton(_EPISODE_ROWS)},
  means AS (SELECT t.stream, t.time, avg(w1 * exp(b) / (w0 + w1 * exp(b))) AS mean FROM steps t JOIN fitted f ON f.stream = t.stream GROUP BY t.stream, t.time),
  sized AS (SELECT r.stream, any_value(r.b) AS b, sum(w1 * exp(r.b) / (w0 + w1 * exp(r.b)) * (1 - w1 * exp(r.b) / (w0 + w1 * exp(r.b)))) AS info
   FROM fitted r JOIN steps t ON t.stream = r.stream GROUP BY r.stream),
  total AS (SELECT CAST(sum(event) AS DOUBLE) AS n FROM long)
  SELECT {_scaled(1)} AS z1, {_scaled(2)} AS z2, {_scaled(3)} AS z3 FROM long e JOIN means m ON m.stream = e.stream AND m.time = e.time WHERE e.event = 1"""
_EPISODE_COVARIANCE = f"""SELECT row_term, column_term, n, covariance FROM (WITH scaled AS ({_EPISODE_SCALED}) """ + " UNION ALL ".join(
    f"SELECT '{t}' AS row_term, '{u}' AS column_term, CAST(count(*) AS BIGINT) AS n, "
    + (f"round(covar_samp({_EPISODE_VALUES[t]}, {_EPISODE_VALUES[u]}), 5)" if t in _EPISODE_VALUES and u in _EPISODE_VALUES else "CAST(NULL AS DOUBLE)")
    + " AS covariance FROM scaled"
    for i, t in enumerate(_EPISODE_NAMES)
    for u in _EPISODE_NAMES[i:]
) + ")"

def _kmeans(steps: int = 40) -> str:
    """Assignments step by step from the rule clusters; distances from the active bins alone."""
    parts = [
        "hits AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT DISTINCT '{s}' AS stream, p_id, bin FROM bins_{s} WHERE p_id IN (SELECT p_id FROM participants)" for s in STREAMS) + ")",
        "label_0 AS MATERIALIZED (" + " UNION ALL ".join(
            f"SELECT '{s}' AS stream, p_id, CAST(dense_rank() OVER (ORDER BY cluster) - 1 AS BIGINT) AS c FROM clusters_{s}" for s in STREAMS) + ")",
    ]
    for t in range(steps):
        parts.append(f"size_{t} AS MATERIALIZED (SELECT stream, c, CAST(count(*) AS DOUBLE) AS n FROM label_{t} GROUP BY stream, c)")
        parts.append(f"center_{t} AS MATERIALIZED (SELECT l.stream, l.c, h.bin, count(*) / any_value(z.n) AS m FROM label_{t} l JOIN hits h ON h.stream = l.stream AND h.p_id = l.p_id"
                     f" JOIN size_{t} z ON z.stream = l.stream AND z.c = l.c GROUP BY l.stream, l.c, h.bin)")
        parts.append(f"norm_{t} AS MATERIALIZED (SELECT z.stream, z.c, coalesce(sum(m * m), 0) AS s FROM size_{t} z LEFT JOIN center_{t} e ON e.stream = z.stream AND e.c = z.c GROUP BY z.stream, z.c)")
        parts.append(f"""label_{t + 1} AS MATERIALIZED (SELECT stream, p_id, arg_min(c, round(s - 2 * dot, 9) * 1000.0 + c * 1e-7) AS c FROM (
  SELECT l.stream, l.p_id, n.c, any_value(n.s) AS s, coalesce(sum(e.m), 0) AS dot
  FROM label_{t} l JOIN norm_{t} n ON n.stream = l.stream LEFT JOIN hits h ON h.stream = l.stream AND h.p_id = l.p_id
  LEFT JOIN center_{t} e ON e.stream = l.stream AND e.c = n.c AND e.bin = h.bin GROUP BY l.stream, l.p_id, n.c) GROUP BY stream, p_id)""")
    return ",\n".join(parts)


_PATTERNS = "patterns AS MATERIALIZED (" + " UNION ALL ".join(
    f"""SELECT '{s}' AS stream, w, any_value(vec) AS vec, CAST(count(*) AS DOUBLE) AS n FROM (SELECT p.p_id, list_transform(range(0, {-(-bins // 64)}), lambda k:
   list_sum(list_transform(coalesce(b.bins, []), lambda b: CASE WHEN (b - 1) // 64 <> k THEN 0::HUGEINT WHEN (b - 1) % 64 = 63 THEN -9223372036854775808::HUGEINT
    ELSE 1::HUGEINT << CAST((b - 1) % 64 AS HUGEINT) END))::BIGINT) AS w,
   array_to_string(list_transform(range(1, {bins + 1}), lambda x: CASE WHEN list_contains(coalesce(b.bins, []), x) THEN '1' ELSE '0' END), '') AS vec
   FROM participants p LEFT JOIN (SELECT p_id, list(DISTINCT bin) AS bins FROM bins_{s} GROUP BY p_id) b ON b.p_id = p.p_id) GROUP BY w"""
    for s, bins in (("active", 22), ("phone", 301), ("fitbit", 301))
) + ")"
_APART = "sqrt(list_sum(list_transform(list_zip(a.w, b.w), lambda x: bit_count(xor(coalesce(x[1], 0), coalesce(x[2], 0))))))"

_TEXTS = {
    "cox_one_covariate": _ONE_COVARIATE,
    "zph_one_covariate": _TREND,
    "cox_episode_effect": _EPISODE_EFFECT,
    "enrollment_dim": "SELECT p_id, enrollment_date, withdrawal_date, CAST(date_diff('day', DATE '2017-11-30', enrollment_date) AS BIGINT) AS delta_enrol_vs_study_start FROM fx_enrollment",
    "participant_dates": """SELECT p_id, active_first, active_last, passive_first, passive_last, phone_first, phone_last, fitbit_first, fitbit_last,
 clin_first, clin_last, enrollment_date
 FROM (SELECT p_id, CAST(min(ts) AS DATE) AS active_first, CAST(max(ts) AS DATE) AS active_last FROM fx_active GROUP BY p_id)
 FULL JOIN (SELECT p_id, CAST(min(ts) AS DATE) AS passive_first, CAST(max(ts) AS DATE) AS passive_last FROM fx_passive GROUP BY p_id) USING (p_id)
 FULL JOIN (SELECT p_id, CAST(min(ts) AS DATE) AS phone_first, CAST(max(ts) AS DATE) AS phone_last FROM fx_passive WHERE data_name = 'Passive_phone' GROUP BY p_id) USING (p_id)
 FULL JOIN (SELECT p_id, CAST(min(ts) AS DATE) AS fitbit_first, CAST(max(ts) AS DATE) AS fitbit_last FROM fx_passive WHERE data_name = 'Passive_Fitbit' GROUP BY p_id) USING (p_id)
 FULL JOIN (SELECT p_id, min(date) AS clin_first, max(date) AS clin_last FROM fx_ids GROUP BY p_id) USING (p_id)
 FULL JOIN (SELECT p_id, enrollment_date FROM fx_enrollment) USING (p_id)""",
    "drop_dummy_ids": "SELECT p_id, CAST(count(*) AS BIGINT) AS n FROM fx_active WHERE p_id NOT IN (207, 209, 227) OR p_id IS NULL GROUP BY p_id",
    "unenrolled_ids": "SELECT p_id FROM outside",
    "unenrolled_removed": "SELECT p_id, CAST(count(*) AS BIGINT) AS n FROM fx_active WHERE p_id NOT IN (SELECT p_id FROM outside) GROUP BY p_id",
    "distinct_participants": """SELECT 'active' AS stream, CAST(count(DISTINCT p_id) AS BIGINT) AS n_participants FROM fx_active
 UNION ALL SELECT 'passive', CAST(count(DISTINCT p_id) AS BIGINT) FROM fx_passive""",
    "study_window": "SELECT (SELECT min(enrollment_date) FROM fx_enrollment) AS first_day, (SELECT last_day FROM last_day) AS last_day",
    "day_index": f"""SELECT p_id, ts, {_i('day_in_study')}, CAST(floor(day_in_study / 7.0) + 1 AS BIGINT) AS week_a,
 CAST(floor((day_in_study - 1) / 7.0) + 1 AS BIGINT) AS week_b, CAST(floor((day_in_study - 1) / 14.0) + 1 AS BIGINT) AS biweek
 FROM (SELECT p_id, ts, date_diff('day', enrollment_date, CAST(ts AS DATE)) + 1 AS day_in_study FROM fx_passive JOIN fx_enrollment USING (p_id))""",
    "daily_activity": f"""SELECT p_id, data_name, {_i('day_in_study')}, CAST(count(*) AS BIGINT) AS n
 FROM (SELECT p_id, data_name, date_diff('day', enrollment_date, CAST(ts AS DATE)) + 1 AS day_in_study FROM fx_passive JOIN fx_enrollment USING (p_id))
 WHERE day_in_study BETWEEN 1 AND 301 GROUP BY p_id, data_name, day_in_study""",
    "daily_activity_subday": f"SELECT p_id, data_name, {_i('day_in_study', 'n')} FROM ({_subday_daily()})",
    "last_activity": "SELECT * FROM last_cohort_1",
    "last_activity_cohort_2": "SELECT * FROM last_cohort_2",
    "last_activity_subday": "SELECT * FROM last_subday",
    "dropout_labels": f"SELECT p_id, stream, {_i('duration', 'event')} FROM labels_1",
    "dropout_labels_cohort_2": f"SELECT p_id, stream, {_i('duration', 'event')} FROM labels_2",
    "recode_lookup": """SELECT d.p_id, s.phone_brand AS brand, s.employment, CASE WHEN s.employment IN ('Yes', 'No') THEN s.employment END AS employment_cat,
 CAST(CASE WHEN d.phone_status = 1 THEN 1 ELSE 0 END AS BIGINT) AS phone_status_cat,
 CASE d.marry_align WHEN 'HOUSEHOLD' THEN 'Married' WHEN 'BUILDING' THEN 'Married' WHEN 'MACHINERY' THEN 'Single' WHEN 'AUTOMOBILE' THEN 'Single' END AS marry_cat
 FROM fx_demog d JOIN star s USING (p_id)""",
    "threshold_bands": f"""SELECT d.p_id, {_AGE} WHEN age IS NOT NULL THEN '>60' END AS age_band, {_AGE} ELSE '>60' END AS age_band_compat,
 CASE WHEN sum_phq8 >= 20 THEN 'severe' WHEN sum_phq8 >= 15 THEN 'moderately severe' WHEN sum_phq8 >= 10 THEN 'moderate'
  WHEN sum_phq8 >= 5 THEN 'mild' WHEN sum_phq8 >= 0 THEN 'no depressive symptoms' END AS phq_band,
 CAST(least(brand_code, 3) AS BIGINT) AS items_capped FROM fx_demog d LEFT JOIN baseline USING (p_id)""",
    "survey_scores": "SELECT p_id, start_time, CAST(sum_phq8 AS BIGINT) AS sum_phq8, CAST(CASE WHEN sum_rses <= 20 THEN sum_rses END AS BIGINT) AS sum_rses FROM surveys",
    "survey_response_lag": f"SELECT p_id, start_time, {_r('response_lag / 60.0', 'response_lag_min')}, CAST(total_time_taken AS DOUBLE) AS total_time_taken FROM surveys",
    "demographics_star": f"SELECT p_id, age, sex, site, phone_brand AS brand, employment, {_i('comorb_sum', 'comorb', 'phone_status')} FROM people",
    "null_profile": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS n_null, CAST(count(*) AS BIGINT) AS n_rows"
        " FROM people LEFT JOIN fx_enrollment USING (p_id)"
        for c in _PEOPLE_NULLS
    ),
    "contact_count": f"SELECT p_id, {_i('num_contact')} FROM contacts_1",
    "baseline_first": f"SELECT p_id, {_i('sum_phq8')} FROM baseline",
    "baseline_max": f"SELECT p_id, {_i('sum_phq8', 'sum_rses')} FROM base_max",
    "baseline_top1": f"""SELECT p_id, {_i('sum_phq8', 'total_time_taken')} FROM (SELECT p_id, sum_phq8, total_time_taken,
 row_number() OVER (PARTITION BY p_id ORDER BY sum_phq8 DESC, total_time_taken) AS rn FROM early) WHERE rn = 1""",
    "ids_in_period": f"SELECT p_id, {_i('count_ids', 'baseline_ids')} FROM visit_sum",
    "survey_period_summary": f"""SELECT a.p_id, {_r('b.mean_phq8_score', 'mean_phq8_score')}, {_r('a.mean_phq8_score', 'median_phq8_score')},
 {_r('a.phq8_response_min', 'phq8_response_min')}, {_r('a.phq8_total_s', 'phq8_total_s')}, {_r('a.mean_rses_score', 'mean_rses_score')}
 FROM survey_sum a JOIN ({_survey_summary(301, 'avg')}) b USING (p_id)""",
    "survey_period_summary_cohort_2": f"SELECT p_id, {_summary_columns()} FROM ({_survey_summary(660, 'avg')})",
    "rses_period_summary": f"SELECT p_id, {_r('mean_rses_score', 'mean_rses_score')}, {_r('rses_response_min', 'rses_response_min')}, {_r('rses_total_s', 'rses_total_s')} FROM rses_sum",
    "days_in_study": f"SELECT p_id, type, {_i('value')} FROM study_days",
    "cohort_members": """SELECT DISTINCT 'cohort_1' AS cohort, p_id FROM study_days WHERE type = 'theoretical_max' AND value >= 301
 UNION ALL SELECT 'cohort_2', p_id FROM members_2""",
    "quantile_grid": """SELECT type, CAST(2 * i AS DOUBLE) AS quantile, round(quantile_cont(value, [x / 50.0 FOR x IN range(0, 51)])[i + 1], 6) AS value
 FROM study_days, (SELECT unnest(range(0, 51)) AS i) GROUP BY type, i""",
    "quantile_compare": """SELECT type, CAST(5 * i AS DOUBLE) AS quantile, round(quantile_cont(value, [x / 20.0 FOR x IN range(0, 21)])[i + 1], 6) AS value
 FROM study_days, (SELECT unnest(range(0, 21)) AS i) GROUP BY type, i""",
    "activity_grid_biweek": _grid("bins_active", 22),
    "activity_grid_daily": " UNION ALL ".join(f"SELECT '{s}' AS stream, * FROM ({_grid(f'bins_{s}', 301)})" for s in ("phone", "fitbit")),
    "activity_vector": _vector(301, 22, ""),
    "activity_vector_cohort_2": _vector(660, 48, "WHERE p_id IN (SELECT p_id FROM members_2)"),
    "activity_pivot": "SELECT p.p_id, "
    + ", ".join(f"CAST(coalesce(max(CASE WHEN bin = {i} THEN 1 END), 0) AS BIGINT) AS b{i}" for i in range(1, 23))
    + " FROM participants p LEFT JOIN bins_active b ON b.p_id = p.p_id GROUP BY p.p_id",
    "engagement_counts": " UNION ALL ".join(
        f"SELECT p_id, '{s}' AS stream, CAST(engaged AS BIGINT) AS engaged_bins, CAST(engaged * {14 if s == 'active' else 1} AS BIGINT) AS engaged_days FROM clusters_{s}"
        for s in STREAMS
    ),
    "bin_labels": """SELECT CAST(bin - 1 AS BIGINT) AS bin, CASE WHEN (bin - 1) % 14 = 0 THEN CAST(((bin - 1) // 14) * 2 + 1 AS VARCHAR) ELSE '' END AS label,
 CAST(count(DISTINCT p_id) AS BIGINT) AS n_active FROM bins_phone GROUP BY bin""",
    "cluster_profile": f"""SELECT stream, p_id, cluster, age, sex, site, {_i('engaged', 'num_contact', 'count_ids', 'baseline_ids')},
 {_summary_columns()}, CAST(sum_phq8 AS BIGINT) AS baseline_phq8 FROM profile""",
    "cluster_bin_rate": " UNION ALL ".join(
        f"""SELECT '{s}' AS stream, z.cluster, CAST(g.bin AS BIGINT) AS bin, CAST(z.n AS BIGINT) AS n, round(coalesce(h.hits, 0) / CAST(z.n AS DOUBLE), 6) AS active_rate
 FROM (SELECT cluster, count(*) AS n FROM clusters_{s} GROUP BY cluster) z CROSS JOIN (SELECT unnest(range(1, {(22 if s == 'active' else 301) + 1})) AS bin) g
 LEFT JOIN (SELECT cluster, bin, count(DISTINCT p_id) AS hits FROM bins_{s} JOIN clusters_{s} USING (p_id) GROUP BY cluster, bin) h
 ON h.cluster = z.cluster AND h.bin = g.bin"""
        for s in STREAMS
    ),
    "longitudinal_by_group": _quartiles("SELECT stream, cluster, variable, value FROM records JOIN placed USING (p_id)", "stream, cluster, variable"),
    "cluster_union_streams": f"""SELECT cat, p_id, cluster, age, {_i('engaged_days')}, {_r('mean_phq8_score', 'mean_phq8_score')},
 {_r('phq8_response_min', 'phq8_response_min')}, {_r('phq8_total_s', 'phq8_total_s')}, {_r('total_time', 'total_time')},
 CAST(sum_phq8 AS BIGINT) AS baseline_phq8 FROM streams_all""",
    "cluster_extremes": " UNION ALL ".join(
        f"SELECT p_id, cluster || '_{s}' AS cluster, CAST(engaged AS BIGINT) AS engaged FROM clusters_{s} WHERE cluster IN ('C1', 'C4')" for s in STREAMS
    ),
    "table_one_continuous": _quartiles(_unpivot("profile", "stream, cluster AS stratum", _NUMBERS, "DOUBLE"), "stream, variable, stratum"),
    "table_one_categorical": _categorical("profile", "cluster", _FACTORS, "stream, "),
    "comparison_report": f"SELECT * FROM ({_report()})",
    "table_one_site": _quartiles(_unpivot("people", "site AS stratum", ["age", "edu_age_align", "comorb_sum"], "DOUBLE"), "variable, stratum"),
    "table_one_overall": _categorical("people", "'Overall'", _FACTORS),
    "kruskal_wallis": _KRUSKAL,
    "chi_square": f"""SELECT round(chi2, 6) AS chi2, CAST(df AS BIGINT) AS df, CAST(n AS BIGINT) AS n, round(exp(-chi2 / 2) * (1 + chi2 / 2), 6) AS p
 FROM (WITH t AS (SELECT {_AGE} WHEN age IS NOT NULL THEN '>60' END AS a, CASE WHEN employment IN ('Yes', 'No') THEN employment END AS b FROM people),
  k AS (SELECT a, b FROM t WHERE a IS NOT NULL AND b IS NOT NULL),
  e AS (SELECT r.a, c.b, r.n * c.n / CAST((SELECT count(*) FROM k) AS DOUBLE) AS e FROM (SELECT a, count(*) AS n FROM k GROUP BY a) r
   CROSS JOIN (SELECT b, count(*) AS n FROM k GROUP BY b) c),
  o AS (SELECT a, b, count(*) AS o FROM k GROUP BY a, b)
  SELECT sum(pow(coalesce(o, 0) - e, 2) / e) AS chi2, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS df, (SELECT count(*) FROM k) AS n
  FROM e LEFT JOIN o USING (a, b))""",
    "chi_square_two_by_two": """SELECT round(chi2, 6) AS chi2, CAST(1 AS BIGINT) AS df, CAST(n AS BIGINT) AS n
 FROM (WITH k AS (SELECT sex AS a, comorb AS b FROM people WHERE comorb IS NOT NULL),
  e AS (SELECT r.a, c.b, r.n * c.n / CAST((SELECT count(*) FROM k) AS DOUBLE) AS e FROM (SELECT a, count(*) AS n FROM k GROUP BY a) r
   CROSS JOIN (SELECT b, count(*) AS n FROM k GROUP BY b) c),
  o AS (SELECT a, b, count(*) AS o FROM k GROUP BY a, b)
  SELECT sum(pow(abs(coalesce(o, 0) - e) - least(0.5, abs(coalesce(o, 0) - e)), 2) / e) AS chi2, (SELECT count(*) FROM k) AS n
  FROM e LEFT JOIN o USING (a, b))""",
    "histogram_counts": " UNION ALL ".join(
        f"SELECT CAST({a} AS DOUBLE) AS lo, CAST({b} AS DOUBLE) AS hi, CAST(count(*) FILTER (WHERE age {'>=' if a == 18 else '>'} {a} AND age <= {b}) AS BIGINT) AS n FROM fx_demog"
        for a, b in zip((18, 30, 40, 50, 60, 70), (30, 40, 50, 60, 70, 80))
    ),
    "density_grid": """SELECT s.type, round(g.x, 9) AS x, round(sum(exp(-0.5 * pow((g.x - s.value) / b.h, 2))) / (b.n * b.h * sqrt(2 * pi())), 9) AS density
 FROM study_days s
 JOIN (SELECT type, count(*) AS n, 0.9 * least(stddev_samp(value), (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.34) * pow(count(*), -0.2) AS h
  FROM study_days GROUP BY type) b ON b.type = s.type
 CROSS JOIN (SELECT lo + (hi - lo) * i / 511.0 AS x FROM (SELECT min(value) AS lo, max(value) AS hi FROM study_days), (SELECT unnest(range(0, 512)) AS i)) g
 GROUP BY s.type, g.x, b.n, b.h""",
    "boxplot_by_group": f"""SELECT v.variable, v.cat, v.cluster, {_r('min(value) FILTER (WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))', 'lower_whisker')},
 round(any_value(q1), 6) AS q1, round(any_value(m), 6) AS median, round(any_value(q3), 6) AS q3,
 {_r('max(value) FILTER (WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))', 'upper_whisker')}
 FROM ({_BOX_SOURCE}) v JOIN (SELECT variable, cat, cluster, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS q3
  FROM ({_BOX_SOURCE}) WHERE value IS NOT NULL GROUP BY variable, cat, cluster) q USING (variable, cat, cluster) GROUP BY v.variable, v.cat, v.cluster""",
    "whisker_limits": f"""SELECT variable, round(min(value) * CASE WHEN variable = 'phq8_response_min' THEN 0.0 ELSE 1.0 END, 6) AS lo, round(max(value) * 1.1, 6) AS hi
 FROM (WITH v AS (SELECT variable, value, row_number() OVER (PARTITION BY variable ORDER BY value) AS rn, count(*) OVER (PARTITION BY variable) AS n
   FROM ({_WHISKER_SOURCE}) WHERE value IS NOT NULL),
  h AS (SELECT variable, (max(value) FILTER (WHERE rn = floor(floor((n + 3) / 2) / 2)) + max(value) FILTER (WHERE rn = ceil(floor((n + 3) / 2) / 2))) / 2 AS lo,
   (max(value) FILTER (WHERE rn = floor(n + 1 - floor((n + 3) / 2) / 2)) + max(value) FILTER (WHERE rn = ceil(n + 1 - floor((n + 3) / 2) / 2))) / 2 AS hi FROM v GROUP BY variable)
  SELECT v.variable, value FROM v JOIN h USING (variable) WHERE value BETWEEN lo - 1.5 * (hi - lo) AND hi + 1.5 * (hi - lo)) GROUP BY variable""",
    "level_frequency": f"SELECT variable, site, level, CAST(count(*) AS BIGINT) AS n FROM ({_LEVEL_SOURCE}) GROUP BY GROUPING SETS ((variable, level), (variable, site, level))",
    "demographic_summary": f"""SELECT site, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE sex = 'female') AS BIGINT) AS n_female, {_r('avg(age)', 'mean_age')},
 {_r('stddev_samp(age)', 'sd_age')}, {_r('avg(edu_age_align)', 'mean_edu')}, {_r('stddev_samp(edu_age_align)', 'sd_edu')},
 CAST(count(*) FILTER (WHERE age < 20) AS BIGINT) AS n_under20, CAST(count(*) FILTER (WHERE age > 70) AS BIGINT) AS n_over70
 FROM fx_demog GROUP BY GROUPING SETS ((), (site))""",
    "numeric_summary": f"""SELECT variable, {_r('min(value)', 'min')}, {_r('quantile_cont(value, 0.25)', 'q1')}, {_r('median(value)', 'median')}, {_r('avg(value)', 'mean')},
 {_r('quantile_cont(value, 0.75)', 'q3')}, {_r('max(value)', 'max')} FROM ({_unpivot('fx_demog', '1 AS one', ['age', 'edu_age_align'], 'DOUBLE')}) GROUP BY variable""",
    "survival_cohort": f"""SELECT p_id, age_band, sex, marry_cat, employment_cat, {_r('edu_age_align', 'edu_age_align')}, {_i('phq_base')}, phq_band, {_i('comorb')}, site, phone_brand,
 {_i('phone_status_cat', 'num_contact', *[f'{k}_{s}' for s in STREAMS for k in ('duration', 'event')])} FROM cohort_table""",
    "km_curve": f"SELECT {_KM_OUT} FROM km_1",
    "km_curve_cohort_2": f"SELECT {_KM_OUT} FROM ({_km('labels_2', 'stream')})",
    "km_curve_by_sex": f"SELECT sex, {_KM_OUT} FROM ({_km('(SELECT l.*, d.sex FROM labels_1 l LEFT JOIN fx_demog d USING (p_id))', 'stream, sex')})",
    "km_curve_subday": f"SELECT {_KM_OUT} FROM ({_km(_SUBDAY_LABELS, 'stream')})",
    "km_confidence": """SELECT stream, CAST(time AS BIGINT) AS time, round(surv, 6) AS surv, round(se, 6) AS se,
 round(surv * exp(-1.959963984540054 * se), 6) AS lower, CASE WHEN se IS NOT NULL THEN round(least(1.0, surv * exp(1.959963984540054 * se)), 6) END AS upper
 FROM (SELECT *, CASE WHEN surv > 0 THEN sqrt(sum(CASE WHEN n_risk > n_event THEN n_event / (CAST(n_risk AS DOUBLE) * (n_risk - n_event)) END)
  OVER (PARTITION BY stream ORDER BY time)) END AS se FROM km_1)""",
    "km_median": """SELECT stream, CASE WHEN max(CASE WHEN abs(surv - 0.5) <= 1e-9 THEN 1 END) = 1
  THEN (min(time) FILTER (WHERE surv <= 0.5 + 1e-9) + coalesce(min(time) FILTER (WHERE surv < 0.5 - 1e-9), min(time) FILTER (WHERE surv <= 0.5 + 1e-9))) / 2.0
  ELSE CAST(min(time) FILTER (WHERE surv <= 0.5 + 1e-9) AS DOUBLE) END AS median_time FROM km_1 GROUP BY stream""",
    "episode_split": _episodes("labels_1", "phone", (130, 240)),
    "episode_split_cohort_2": _episodes("labels_2", "active", (320,)),
    "design_matrix": "SELECT p_id, " + ", ".join(_r(e, f"x_{i + 1}") for i, e in enumerate(_DESIGN)) + f" FROM cohort_table WHERE {_COMPLETE}",
    "schoenfeld_at_zero": f"SELECT p_id, stream, CAST(time AS BIGINT) AS time, unnest(['age', 'sex=male']) AS term, round(unnest([age, male]), 6) AS resid FROM ({_ZERO_RESIDUALS})",
    "residual_covariance_at_zero": " UNION ALL ".join(
        f"SELECT stream, '{t}' AS row_term, '{u}' AS column_term, CAST(count(*) AS BIGINT) AS n, round(covar_samp({a}, {b}), 6) AS covariance FROM ({_ZERO_RESIDUALS}) GROUP BY stream"
        for t, a, u, b in (("age", "age", "age", "age"), ("age", "age", "sex=male", "male"), ("sex=male", "male", "sex=male", "male"))
    ),
    "residual_covariance_by_episode": _EPISODE_COVARIANCE,
    "concordance_of_baseline": f"""SELECT stream, round((lower + tied / 2.0) / pairs, 6) AS concordance, CAST(pairs AS DOUBLE) AS pairs
 FROM ({_concordance("""SELECT s.stream, CASE s.stream WHEN 'active' THEN duration_active WHEN 'phone' THEN duration_phone ELSE duration_fitbit END AS time,
   CASE s.stream WHEN 'active' THEN event_active WHEN 'phone' THEN event_phone ELSE event_fitbit END AS event, phq_base * 2.0 + edu_age_align / 1000.0 AS risk
   FROM cohort_table CROSS JOIN (SELECT unnest(['active', 'phone', 'fitbit']) AS stream) s WHERE phq_base * 2.0 + edu_age_align / 1000.0 IS NOT NULL""")})""",
    "cox_summary_one_covariate": f"""SELECT c.stream, n, n_event, loglik_null, loglik, round(2 * (ll - null_ll), 5) AS lr, CAST(1 AS BIGINT) AS df, round(2 - 2 * ll, 5) AS aic,
 round((CASE WHEN b > 0 THEN lower WHEN b < 0 THEN higher ELSE 0 END + tied / 2.0) / pairs, 5) AS concordance, CAST(pairs AS DOUBLE) AS pairs, TRUE AS converged
 FROM ({_ONE_COVARIATE_FIT}) f JOIN ({_concordance(_STREAM_ROWS.replace("CASE WHEN sex = 'male' THEN 1 ELSE 0 END AS male", "CASE WHEN sex = 'male' THEN 1 ELSE 0 END AS risk"))}) c ON c.stream = f.stream""",
    "kmeans_from_rules": f"SELECT * FROM (WITH {_kmeans()} SELECT stream, p_id, c AS raw_cluster FROM label_40)",
    "kmeans_from_rules_wss": f"""SELECT stream, k, round(wss, 6) AS wss FROM (WITH {_kmeans()}
 SELECT z.stream, CAST(count(DISTINCT z.c) AS BIGINT) AS k, sum(coalesce(e.within, 0)) AS wss FROM (SELECT stream, c FROM label_40 GROUP BY stream, c) z
 LEFT JOIN (SELECT stream, c, sum(ones - ones * ones / n) AS within FROM (SELECT l.stream, l.c, h.bin, CAST(count(*) AS DOUBLE) AS ones, any_value(t.n) AS n
   FROM label_40 l JOIN hits h ON h.stream = l.stream AND h.p_id = l.p_id
   JOIN (SELECT stream, c, count(*) AS n FROM label_40 GROUP BY stream, c) t ON t.stream = l.stream AND t.c = l.c GROUP BY l.stream, l.c, h.bin) GROUP BY stream, c) e
 ON e.stream = z.stream AND e.c = z.c GROUP BY z.stream)""",
    "medoid_single": f"""SELECT stream, CAST(1 AS BIGINT) AS k, vec AS medoid, size, round(cost, 6) AS cost, wss FROM (WITH {_PATTERNS},
  p AS (SELECT stream, vec, n, list_transform(w, lambda x: coalesce(x, 0)) AS w FROM patterns),
  sums AS (SELECT a.stream, a.w, any_value(a.vec) AS vec, sum(b.n * {_APART}) AS cost FROM p a JOIN p b ON a.stream = b.stream GROUP BY a.stream, a.w),
  spread AS (SELECT h.stream, sum(ones - ones * ones / z.n) AS wss, any_value(z.n) AS n FROM ({" UNION ALL ".join(f"SELECT '{s}' AS stream, bin, CAST(count(DISTINCT p_id) AS DOUBLE) AS ones FROM bins_{s} WHERE p_id IN (SELECT p_id FROM participants) GROUP BY bin" for s in STREAMS)}) h
   CROSS JOIN (SELECT count(*) AS n FROM participants) z GROUP BY h.stream)
  SELECT s.stream, s.vec, s.cost, round(x.wss, 6) AS wss, CAST(x.n AS BIGINT) AS size, row_number() OVER (PARTITION BY s.stream ORDER BY round(cost, 7), s.w) AS place
  FROM sums s JOIN spread x ON x.stream = s.stream) WHERE place = 1""",
    "medoid_pair_cost": f"""SELECT * FROM (WITH {_PATTERNS}, p AS (SELECT w, n, row_number() OVER (ORDER BY w) AS id FROM patterns WHERE stream = 'active'),
  apart AS MATERIALIZED (SELECT a.id AS a, b.id AS b, b.n, {_APART} AS d FROM p a CROSS JOIN p b)
  SELECT 'active' AS stream, CAST(1 AS BIGINT) AS k, round(min(cost), 6) AS cost FROM (SELECT a, sum(n * d) AS cost FROM apart GROUP BY a)
  UNION ALL SELECT 'active', CAST(2 AS BIGINT), round(min(cost), 6) FROM (SELECT x.a, y.a, sum(x.n * least(x.d, y.d)) AS cost FROM apart x JOIN apart y ON x.b = y.b AND x.a < y.a GROUP BY x.a, y.a))""",
    "cluster_membership": " UNION ALL ".join(
        f"""SELECT '{s}' AS stream, p_id, cluster, CAST(row_number() OVER (ORDER BY cluster, p_id) AS BIGINT) AS position,
 CAST(row_number() OVER (PARTITION BY cluster ORDER BY p_id) AS BIGINT) AS row_in_cluster FROM clusters_{s}"""
        for s in STREAMS
    ),
}

ORACLES = {name: _sql(text) for name, text in _TEXTS.items()}
