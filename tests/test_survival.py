"""Kaplan-Meier, episodes and Cox models against direct computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortwise.operators import cox, survival
from cohortwise.operators.survival import ByStratum, Factor, Numeric


def labels(spark, rows):
    return spark.createDataFrame(rows, "p_id string, duration int, event int").withColumn("stream", F.lit("s"))


def test_curve_by_hand_reaches_zero(spark):
    df = labels(spark, [("a", 1, 1), ("b", 2, 1), ("c", 3, 1), ("d", 3, 1)])
    curve = survival.km_curve(df)
    rows = survival.km_confidence(curve).orderBy("time").collect()
    assert [(r.time, r.n_risk, r.n_event) for r in rows] == [(1, 4, 1), (2, 3, 1), (3, 2, 2)]
    assert [r.surv for r in rows] == [0.75, 0.5, 0.0]
    assert rows[0].se == pytest.approx(math.sqrt(1 / 12))
    assert rows[0].lower == pytest.approx(0.75 * math.exp(-1.959963984540054 * math.sqrt(1 / 12))) and rows[0].upper == 1.0
    assert (rows[2].se, rows[2].lower, rows[2].upper) == (None, None, None)
    assert survival.km_median(curve).first().median_time == 2.5


def test_median_when_the_curve_jumps_over_one_half_or_never_gets_there(spark):
    jump = labels(spark, [("a", 1, 1), ("b", 4, 1), ("c", 4, 1)])
    assert survival.km_median(survival.km_curve(jump)).first().median_time == 4.0
    high = labels(spark, [("a", 1, 1), ("b", 4, 0), ("c", 4, 0)])
    assert survival.km_median(survival.km_curve(high)).first().median_time is None


def test_curve_keeps_negative_times(spark):
    rows = survival.km_curve(labels(spark, [("a", -2, 1), ("b", 0, 0), ("c", 5, 1)])).orderBy("time").collect()
    assert [(r.time, r.n_risk, r.n_censor) for r in rows] == [(-2, 3, 0), (0, 2, 1), (5, 1, 0)]


def test_episode_split(spark):
    df = labels(spark, [("m", -2, 1), ("z", 0, 1), ("a", 130, 1), ("b", 131, 0), ("c", 301, 1)]).drop("stream")
    rows = survival.episode_split(df, [130, 240]).collect()
    got = {(r.p_id, r.tgroup): (r.tstart, r.tstop, r.event) for r in rows}
    assert got == {
        ("m", 1): (-3, -2, 1), ("z", 1): (-1, 0, 1), ("a", 1): (-1, 130, 1), ("b", 1): (-1, 130, 0), ("b", 2): (130, 131, 0),
        ("c", 1): (-1, 130, 0), ("c", 2): (130, 240, 0), ("c", 3): (240, 301, 1),
    }
    assert sum(r.event for r in rows) == 4


def direct(x, time, event, strata, beta):
    """Efron log likelihood, gradient, information and residuals by plain loops."""
    p = x.shape[1]
    loglik, gradient, info = 0.0, np.zeros(p), np.zeros((p, p))
    means, spreads = {}, {}
    w = np.exp(x @ beta)
    for s in sorted(set(strata)):
        for t in sorted(set(time[(event == 1) & (strata == s)])):
            risk = (strata == s) & (time >= t)
            died = (strata == s) & (time == t) & (event == 1)
            d = died.sum()
            loglik += (x[died] @ beta).sum()
            mean, spread = np.zeros(p), np.zeros((p, p))
            for l in range(d):
                weight = np.where(risk, w, 0.0) - l / d * np.where(died, w, 0.0)
                total = weight.sum()
                loglik -= math.log(total)
                m = weight @ x / total
                mean += m
                spread += (x * weight[:, None]).T @ x / total - np.outer(m, m)
            gradient += x[died].sum(0) - mean
            info += spread
            means[(s, t)], spreads[(s, t)] = mean / d, spread
    return loglik, gradient, info, means, spreads


def newton(x, time, event, strata):
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        _, g, info, _, _ = direct(x, time, event, strata, beta)
        beta = beta + np.linalg.solve(info, g)
    return beta


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    n = 240
    age = rng.normal(45, 12, n)
    sex = rng.choice(["male", "female"], n)
    group = rng.choice(["u", "v"], n)
    hazard = np.exp(0.03 * (age - 45) + 0.6 * (sex == "male"))
    time = np.ceil(rng.exponential(20 / hazard)).astype(int)
    event = (rng.random(n) < 0.7).astype(int)
    event[time > 40] = 0
    time = np.minimum(time, 41)
    rows = [(f"p{i}", "m", group[i], int(time[i]), int(event[i]), float(age[i]), str(sex[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "p_id string, model string, g string, duration int, event int, age double, sex string").repartition(5)
    x = np.column_stack([age, (sex == "male").astype(float)])
    return df, x, time, event, group


TERMS = [Numeric("age"), Factor("sex", ("female", "male"))]
KEEP = ["p_id", "model", "g", "duration", "event"]


@pytest.fixture(scope="module")
def fit(data):
    return cox.coxph(survival.design_matrix(data[0], TERMS, KEEP), TERMS, model="model")


def test_coefficients_maximise_the_likelihood(data, fit):
    _, x, time, event, _ = data
    beta = newton(x, time, event, np.zeros(len(x)))
    loglik, _, info, _, _ = direct(x, time, event, np.zeros(len(x)), beta)
    rows = {r.term: r for r in fit.coefficients().collect()}
    se = np.sqrt(np.diag(np.linalg.inv(info)))
    assert rows["age"].coef == pytest.approx(beta[0], rel=1e-6) and rows["sex=male"].coef == pytest.approx(beta[1], rel=1e-6)
    assert rows["age"].se == pytest.approx(se[0], rel=1e-6) and rows["sex=male"].se == pytest.approx(se[1], rel=1e-6)
    assert rows["sex=male"].hr == pytest.approx(math.exp(beta[1]), rel=1e-6)
    assert rows["sex=male"].upper == pytest.approx(math.exp(beta[1] + 1.959963984540054 * se[1]), rel=1e-6)
    summary = fit.summary().first()
    assert summary.loglik == pytest.approx(loglik, rel=1e-9) and summary.converged
    assert summary.loglik_null == pytest.approx(direct(x, time, event, np.zeros(len(x)), np.zeros(2))[0], rel=1e-9)
    assert (summary.n, summary.n_event) == (240, event.sum())
    assert summary.aic == pytest.approx(4 - 2 * loglik)


def test_efron_ties_on_six_rows(spark):
    rows = [("a", 1, 1, 1.0), ("b", 2, 1, 1.0), ("c", 2, 1, 0.0), ("d", 3, 0, 1.0), ("e", 4, 1, 0.0), ("f", 5, 0, 0.0)]
    df = spark.createDataFrame(rows, "p_id string, duration int, event int, x double")
    terms = [Numeric("x")]
    fit = cox.coxph(survival.design_matrix(df, terms, ["p_id", "duration", "event"]), terms)
    x = np.array([[r[3]] for r in rows])
    beta = newton(x, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.zeros(6))
    assert fit.coefficients().first().coef == pytest.approx(beta[0], rel=1e-6)


def test_strata(data):
    df, x, time, event, group = data
    fit = cox.coxph(survival.design_matrix(df, TERMS, KEEP), TERMS, stratum="g")
    beta = newton(x, time, event, group)
    assert [r.coef for r in fit.coefficients().collect()] == pytest.approx(list(beta), rel=1e-6)
    constant = cox.coxph(survival.design_matrix(df.withColumn("g", F.lit("one")), TERMS, KEEP), TERMS, stratum="g")
    plain = newton(x, time, event, np.zeros(len(x)))
    assert [r.coef for r in constant.coefficients().collect()] == pytest.approx(list(plain), rel=1e-6)


def test_effect_by_stratum_drops_dependent_columns(data):
    df, x, time, event, group = data
    terms = [Numeric("age"), ByStratum(Factor("sex", ("male", "female")), "g", ("u", "v"))]
    fit = cox.coxph(survival.design_matrix(df, terms, KEEP), terms, stratum="g")
    rows = {r.term: r.coef for r in fit.coefficients().collect()}
    assert rows["sex=female:g=u"] is None and rows["sex=female:g=v"] is None
    design = np.column_stack([x[:, 0], x[:, 1] * (group == "u"), x[:, 1] * (group == "v")])
    beta = newton(design, time, event, group)
    assert [rows["age"], rows["sex=male:g=u"], rows["sex=male:g=v"]] == pytest.approx(list(beta), rel=1e-6)
    tests = {r.term: r.df for r in fit.ph_test().collect()}
    assert tests == {"age": 1, "sex:g": 2, "GLOBAL": 3}


def test_several_models_at_once(data):
    df, x, time, event, group = data
    both = cox.coxph(survival.design_matrix(df, TERMS, KEEP), TERMS, model="g")
    for m in both.models:
        at = group == m.model
        assert list(m.coef) == pytest.approx(list(newton(x[at], time[at], event[at], np.zeros(at.sum()))), rel=1e-6)


def test_constant_columns_are_dropped_and_missing_rows_left_out(data):
    df = data[0].withColumn("one", F.lit(3.0)).withColumn("age", F.when(F.col("p_id") != "p7", F.col("age")))
    terms = [*TERMS, Numeric("one")]
    fit = cox.coxph(survival.design_matrix(df, terms, KEEP), terms)
    rows = fit.coefficients().collect()
    assert rows[2].coef is None and rows[0].coef is not None
    assert fit.summary().first().n == 239


def test_residuals_sum_to_zero_and_match(data, fit):
    _, x, time, event, _ = data
    beta = fit.models[0].coef
    _, _, info, means, _ = direct(x, time, event, np.zeros(len(x)), beta)
    got = {(r.p_id, r.term): (r.resid, r.scaled) for r in fit.schoenfeld().collect()}
    assert len(got) == 2 * event.sum()
    for name in ("age", "sex=male"):
        assert sum(v[0] for k, v in got.items() if k[1] == name) == pytest.approx(0.0, abs=1e-5)
    variance = np.linalg.inv(info)
    for i in np.flatnonzero(event)[:20]:
        resid = x[i] - means[(0.0, time[i])]
        scaled = beta + event.sum() * resid @ variance
        for j, name in enumerate(("age", "sex=male")):
            assert got[(f"p{i}", name)][0] == pytest.approx(resid[j], abs=1e-8)
            assert got[(f"p{i}", name)][1] == pytest.approx(scaled[j], abs=1e-6)


def test_proportional_hazards_score_test(data, fit):
    """Equals the score test of adding x * g(t) to the likelihood, information taken jointly."""
    _, x, time, event, _ = data
    beta = fit.models[0].coef
    _, _, _, means, spreads = direct(x, time, event, np.zeros(len(x)), beta)
    surv, before = 1.0, {}
    for t in sorted(set(time)):
        before[t] = surv
        surv *= 1 - ((time == t) & (event == 1)).sum() / (time >= t).sum()
    died = np.flatnonzero(event)
    center = np.mean([1 - before[time[i]] for i in died])
    g = {t: 1 - before[t] - center for t in before}
    u = np.concatenate([np.zeros(2), sum(g[time[i]] * (x[i] - means[(0.0, time[i])]) for i in died)])
    joint = np.zeros((4, 4))
    for (_, t), v in spreads.items():
        joint += np.block([[v, g[t] * v], [g[t] * v, g[t] ** 2 * v]])
    got = {r.term: r for r in fit.ph_test().collect()}
    for name, index in (("age", [0, 1, 2]), ("sex", [0, 1, 3]), ("GLOBAL", [0, 1, 2, 3])):
        sub = u[index]
        expected = sub @ np.linalg.solve(joint[np.ix_(index, index)], sub)
        assert got[name].chisq == pytest.approx(expected, rel=1e-6)
    assert got["GLOBAL"].df == 2 and 0 <= got["GLOBAL"].p <= 1


def test_concordance_counts_every_comparable_pair(spark):
    rng = np.random.default_rng(2)
    n = 300
    time, event = rng.integers(1, 12, n), rng.integers(0, 2, n)
    risk = np.where(rng.random(n) < 0.4, 1.5, np.round(rng.normal(size=n), 1))
    rows = [("m", int(t), int(e), float(r)) for t, e, r in zip(time, event, risk)]
    df = spark.createDataFrame(rows, "model string, time int, event int, risk double").repartition(6)
    score = pairs = 0.0
    for i in range(n):
        if not event[i]:
            continue
        later = (time > time[i]) | ((time == time[i]) & (event == 0))
        pairs += later.sum()
        score += (risk[later] < risk[i]).sum() + 0.5 * (risk[later] == risk[i]).sum()
    row = cox.concordance(df, n).first()
    assert row.pairs == pairs and row.concordance == pytest.approx(score / pairs, rel=1e-12)


def test_forest_counts_levels(data, fit):
    rows = {(r.variable, r.level): r for r in fit.forest().collect()}
    males = int(data[1][:, 1].sum())
    assert rows[("sex", "male")].n == males and rows[("sex", "female")].n == 240 - males
    assert rows[("sex", "female")].hr == 1.0 and rows[("age", None)].n == 240


def test_concordance_of_a_fit(data, fit):
    row = fit.concordance().first()
    assert 0.5 < row.concordance < 0.8
