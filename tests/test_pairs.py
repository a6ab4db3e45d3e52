"""Concordance, sums over ties, covariance of residual columns and global positions, against direct computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortwise.functions.ordinal import with_positions
from cohortwise.functions.ties import efron_sums
from cohortwise.operators import cluster, cox, survival
from cohortwise.operators.concordance import concordance, merge_count
from cohortwise.operators.covariance import covariance


def counted(time, event, risk, n):
    """Every pair, one by one."""
    lower = tied = pairs = 0
    for i in np.flatnonzero(event):
        later = (time > time[i]) | ((time == time[i]) & (event == 0))
        pairs += int(n[i] * n[later].sum())
        lower += int(n[i] * n[later & (risk < risk[i])].sum())
        tied += int(n[i] * n[later & (risk == risk[i])].sum())
    return lower, tied, pairs


def test_merge_count():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 70))
        time, event, risk, weight = rng.integers(-3, 9, n), rng.integers(0, 2, n), rng.integers(0, 9, n) / 4, rng.integers(1, 5, n)
        assert merge_count(time, event, risk, weight) == counted(time, event, risk, weight)


@pytest.mark.parametrize("bucket_rows", [10, 64, 1_000_000])
def test_concordance_over_many_buckets(spark, bucket_rows):
    """Continuous risks with a third of all rows on one value, several models, one of them without an event."""
    rng = np.random.default_rng(5)
    n = 900
    model = rng.choice(["a", "b", "c"], n, p=[0.6, 0.3, 0.1])
    time, event = rng.integers(-2, 40, n), rng.integers(0, 2, n)
    event[model == "c"] = 0
    risk = np.where(rng.random(n) < 0.35, 0.25, rng.normal(size=n))
    rows = [(m, int(t), int(e), float(r)) for m, t, e, r in zip(model, time, event, risk)]
    scored = spark.createDataFrame(rows, "model string, time int, event int, risk double").repartition(5)
    got = {r.model: r for r in concordance(scored, bucket_rows).collect()}
    for name in "ab":
        at = model == name
        lower, tied, pairs = counted(time[at], event[at], risk[at], np.ones(at.sum(), int))
        assert got[name].pairs == pairs and got[name].concordance == pytest.approx((lower + tied / 2) / pairs, rel=1e-14)
    assert got["c"].concordance is None and got["c"].pairs == 0
    assert concordance(scored.limit(0), bucket_rows).count() == 0


def test_tie_sums_in_constant_work():
    """Equal to adding up the deaths, from one death to a million, from no tied weight to everybody at risk dying."""
    for deaths in (1, 5, 64, 65, 300, 10**4, 10**6):
        for share in (0.0, 1e-12, 1e-5, 0.0499, 0.0501, 0.5, 0.999, 1 - 1e-9, 1.0):
            risk = 7.3 * deaths
            f = np.arange(deaths, dtype=np.longdouble) / np.longdouble(deaths)
            base = np.longdouble(risk) - f * np.longdouble(risk * share)
            expected = [np.log(base).sum(), (1 / base).sum(), (f / base).sum(), (1 / base**2).sum(), (f / base**2).sum(), (f * f / base**2).sum()]
            assert efron_sums([risk], [risk * share], [deaths])[:, 0] == pytest.approx([float(x) for x in expected], rel=1e-10, abs=1e-300)
    many = efron_sums(np.full(3, 1e9), np.array([0.0, 1e7, 1e9]), np.full(3, 1e7))
    assert np.isfinite(many).all() and many[1, 0] == pytest.approx(0.01)


def test_ten_million_tied_deaths_in_a_fit(spark):
    """Weights stand for rows: the likelihood of a table with as many copies follows from the day sums alone."""
    layout = cox._Layout(1)
    packed = np.zeros((2, layout.size))
    packed[:, :2] = [[1e7, 1e7], [2e7, 0.0]]
    packed[0, 2] = 4e6
    packed[:, 3:6] = [[1e7, 4e6, 4e6], [2e7, 1e7, 1e7]]
    packed[0, 6:9] = [1e7, 4e6, 4e6]
    import pandas as pd

    table = pd.DataFrame({"stratum": ["", ""], "time": [1, 2], "packed": list(packed)})
    at = cox._likelihood(table, np.zeros(1), layout)
    f = np.arange(10**7) / 1e7
    base, top = 3e7 - f * 1e7, 1.4e7 - f * 4e6
    assert at["loglik"] == pytest.approx(-np.log(base).sum(), rel=1e-12)
    assert at["gradient"][0] == pytest.approx(4e6 - (top / base).sum(), rel=1e-9)
    assert at["information"][0, 0] == pytest.approx((top / base - (top / base) ** 2).sum(), rel=1e-9)


def test_a_fit_that_does_not_converge_is_an_error(spark):
    rows = [(f"p{i}", i + 1, 1, float(i % 3)) for i in range(12)]
    df = spark.createDataFrame(rows, "p_id string, duration int, event int, x double")
    terms = [survival.Numeric("x")]
    matrix = survival.design_matrix(df, terms, ["p_id", "duration", "event"])
    with pytest.raises(RuntimeError, match="no convergence in 1 steps"):
        cox.coxph(matrix, terms, max_steps=1)
    assert all(r.converged for r in cox.coxph(matrix, terms).summary().collect())


def test_covariance_of_all_pairs(spark):
    rng = np.random.default_rng(7)
    z = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 4)) + [1e6, 0, -3, 5]
    model = rng.choice(["a", "b"], 400)
    frame = spark.createDataFrame([(m, v.tolist()) for m, v in zip(model, z)], "model string, z array<double>").repartition(7)
    shift = {m: [1e6, 0.0, 0.0, 0.0] for m in "ab"}
    got = {(r.model, r.row_term, r.column_term): r for r in covariance(frame, list("wxyz"), shift, {"a": {2}}).collect()}
    assert len(got) == 20
    for m in "ab":
        expected = np.cov(z[model == m].T)
        for i, t in enumerate("wxyz"):
            for j, u in enumerate("wxyz"):
                if i <= j:
                    row = got[m, t, u]
                    assert row.n == (model == m).sum()
                    assert row.covariance is None if m == "a" and "y" in (t, u) else row.covariance == pytest.approx(expected[i, j], rel=1e-9, abs=1e-9)
    assert covariance(frame.limit(0), list("wxyz")).count() == 0


def test_combined_columns_add_up_their_parts(spark):
    """The column of a level over all episodes is the sum of its episodes' columns, as are their covariances."""
    rng = np.random.default_rng(11)
    rows = [(f"p{i}", int(t), int(e), s) for i, (t, e, s) in enumerate(zip(rng.integers(1, 40, 300), rng.integers(0, 2, 300), rng.choice(["male", "female"], 300)))]
    split = survival.episode_split(spark.createDataFrame(rows, "p_id string, duration int, event int, sex string"), (15, 25))
    terms = [survival.ByStratum(survival.Factor("sex", ("male", "female")), "tgroup", (1, 2, 3))]
    fit = cox.coxph(survival.design_matrix(split, terms, ["p_id", "tgroup", "tstop", "event"]), terms, stratum="tgroup", time="tstop")
    wide = np.array([r.scaled for r in fit.residual_rows().collect()])[:, [0, 2, 4]]
    got = {(r.row_term, r.column_term): r.covariance for r in fit.residual_covariance().collect()}
    expected = np.cov(np.column_stack([wide, wide.sum(1)]).T)
    names = ["sex=male:tgroup=1", "sex=male:tgroup=2", "sex=male:tgroup=3", "sex=male:tgroup"]
    for i, t in enumerate(names):
        for j in range(i, 4):
            assert got[t, names[j]] == pytest.approx(expected[i, j], rel=1e-9)
    assert got["sex=female:tgroup", "sex=female:tgroup"] is None


@pytest.mark.parametrize("partitions", ["3", "17"])
def test_positions_are_gapless_in_every_group(spark, partitions):
    rows = [("hot" if i % 3 else f"g{i % 5}" if i % 2 else None, None if i % 11 == 0 else i % 97, i) for i in range(2000)]
    frame = spark.createDataFrame(rows, "g string, v int, p_id int").repartition(6)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        placed = with_positions(frame, [F.col("v"), F.col("p_id")], ["g"]).collect()
        overall = with_positions(frame, [F.col("v"), F.col("p_id")]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    key = lambda r: (r.v is not None, r.v or 0, r.p_id)
    for group in {r.g for r in placed}:
        ordered = sorted((r for r in placed if r.g == group), key=key)
        assert [r.position for r in ordered] == list(range(1, len(ordered) + 1))
    assert [r.position for r in sorted(overall, key=key)] == list(range(1, 2001))


def test_membership_goes_by_level_then_participant(spark):
    rows = [(i, "s", c) for i, c in enumerate(["C2", "C1", "C3", "C1", "C2", "other"])]
    members = spark.createDataFrame(rows, "p_id int, stream string, cluster string")
    got = [tuple(r) for r in cluster.ordered_membership(members, ("C1", "C2", "C3"), ["stream"]).select("p_id", "position", "row_in_cluster").orderBy("position").collect()]
    assert got == [(5, 1, 1), (1, 2, 1), (3, 3, 2), (0, 4, 1), (4, 5, 2), (2, 6, 1)]
