"""Order statistics against NumPy, including hot groups and ties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortwise.operators import compare, describe, ranks


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(3)
    groups = rng.choice(["hot", "b", "c"], size=4000, p=[0.9, 0.09, 0.01])
    x = np.where(rng.random(4000) < 0.3, 5.0, np.round(rng.lognormal(2, 1.5, 4000), 3))
    return groups, x, spark.createDataFrame(list(zip(groups.tolist(), x.tolist())), "g string, value double").repartition(7)


@pytest.mark.parametrize("bounded", [True, False])
def test_quantiles_equal_linear_interpolation(values, bounded):
    groups, x, df = values
    shares = {"q0": 0.0, "q25": 0.25, "q37": 0.37, "q50": 0.5, "q99": 0.99, "q100": 1.0}
    rows = ranks.quantiles(ranks.value_counts(df, ["g"]), ["g"], shares, bounded=bounded).collect()
    assert len(rows) == 3
    for row in rows:
        for name, p in shares.items():
            assert row[name] == pytest.approx(np.quantile(x[groups == row.g], p), rel=1e-12)


def test_running_counts_agree_between_both_forms(values):
    _, _, df = values
    counts = ranks.value_counts(df, ["g"])
    plain = {(r.g, r.value): (r.upto, r.total) for r in ranks.running_counts(counts, ["g"], bounded=True).collect()}
    split = {(r.g, r.value): (r.upto, r.total) for r in ranks.running_counts(counts, ["g"], side=4).collect()}
    assert plain == split


def test_no_bucket_holds_a_large_part_of_a_hot_group(values):
    _, _, df = values
    counts = ranks.value_counts(df, ["g"])
    tagged = ranks._with_bucket(counts.withColumn("value", F.col("value").cast("double")), None, 4)
    largest = tagged.groupBy("g", "__bucket").count().agg(F.max("count")).first()[0]
    assert largest < 0.15 * counts.count()


def kruskal(groups, x):
    order = np.argsort(x, kind="stable")
    r = np.empty(len(x))
    r[order] = np.arange(1, len(x) + 1)
    for v in np.unique(x):
        r[x == v] = r[x == v].mean()
    n = len(x)
    h = 12 / (n * (n + 1)) * sum(r[groups == g].sum() ** 2 / (groups == g).sum() for g in np.unique(groups)) - 3 * (n + 1)
    ties = sum(c**3 - c for c in np.unique(x, return_counts=True)[1])
    return h / (1 - ties / (n**3 - n))


def test_kruskal_wallis(values):
    groups, x, df = values
    row = compare.kruskal_wallis(df.withColumnRenamed("value", "v"), ["v"], "g").first()
    assert (row.n, row.df) == (4000, 2)
    assert row.h == pytest.approx(kruskal(groups, x), rel=1e-9)
    assert row.p == pytest.approx(math.exp(-row.h / 2), rel=1e-9)


def test_kruskal_wallis_of_one_value_has_no_statistic(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "g string, v double")
    row = compare.kruskal_wallis(df, ["v"], "g").first()
    assert row.h is None and row.p is None


def test_histogram_edges(spark):
    df = spark.createDataFrame([(18.0,), (30.0,), (40.0,), (80.0,), (None,)], "age double")
    rows = describe.histogram_counts(df, "age", (18, 30, 40, 50, 60, 70, 80)).collect()
    assert [r.n for r in rows] == [2, 1, 0, 0, 0, 1]


def test_whisker_limits_use_hinges(spark):
    data = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 100.0]
    df = spark.createDataFrame([(v,) for v in data], "value double")
    row = describe.whisker_limits(df.withColumn("k", F.lit("k")), ["k"]).first()
    assert (row.lo, row.hi) == (1.0, 6.0)


def test_boxplot_against_numpy(values):
    groups, x, df = values
    for row in describe.boxplot_stats(df, ["g"]).collect():
        v = x[groups == row.g]
        q1, m, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        assert (row.q1, row.median, row.q3) == pytest.approx((q1, m, q3))
        assert (row.lower_whisker, row.upper_whisker) == (inside.min(), inside.max())


def test_density_integrates_to_about_one_and_matches_kernel(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 300, 500)
    df = spark.createDataFrame([("a", int(v)) for v in x], "type string, value int")
    rows = describe.density_grid(df, "type", points=64).orderBy("x").collect()
    q1, q3 = np.quantile(x, [0.25, 0.75])
    h = 0.9 * min(x.std(ddof=1), (q3 - q1) / 1.34) * len(x) ** -0.2
    for row in rows[::9]:
        expected = np.exp(-0.5 * ((row.x - x) / h) ** 2).sum() / (len(x) * h * math.sqrt(2 * math.pi))
        assert row.density == pytest.approx(expected, rel=1e-9)


def test_chi_square_two_by_two_has_the_correction(spark):
    table = [("a", "x", 10), ("a", "y", 20), ("b", "x", 30), ("b", "y", 25)]
    df = spark.createDataFrame(table, "r string, c string, n bigint")
    row = compare.chi_square(df, [], "r", "c").first()
    o = np.array([[10, 20], [30, 25]])
    e = o.sum(1, keepdims=True) * o.sum(0) / o.sum()
    assert row.chi2 == pytest.approx(((np.abs(o - e) - 0.5) ** 2 / e).sum()) and row.df == 1


def test_chi_square_with_empty_cells(spark):
    o = np.array([[5, 0, 7], [3, 9, 0]])
    cells = [("v", str(i), str(j), int(o[i, j])) for i in range(2) for j in range(3) if o[i, j]]
    df = spark.createDataFrame(cells, "variable string, r string, c string, n bigint")
    row = compare.chi_square(df, ["variable"], "r", "c").first()
    e = o.sum(1, keepdims=True) * o.sum(0) / o.sum()
    assert row.chi2 == pytest.approx(((o - e) ** 2 / e).sum()) and row.df == 2


def test_table_one_reports_missing_values(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), ("a", None, None), ("a", 4.0, "y"), ("b", None, "x"), (None, 9.0, "x")], "s string, v double, k string")
    rows = {r.stratum: r for r in compare.table_one_continuous(df, ["v"], "s").collect()}
    assert (rows["a"].n, rows["a"].n_missing, rows["a"].median) == (2, 1, 2.5)
    assert (rows["b"].n, rows["b"].n_missing, rows["b"].median) == (0, 1, None)
    assert set(rows) == {"a", "b"}
    shares = {(r.stratum, r.level): (r.n, r.pct) for r in compare.table_one_categorical(df, ["k"], "s").collect()}
    assert shares == {("a", "x"): (1, 50.0), ("a", "y"): (1, 50.0), ("b", "x"): (1, 100.0)}
    overall = compare.table_one_categorical(df, ["k"], None).collect()
    assert sum(r.n for r in overall) == 4


def test_strata_counts_add_up_to_overall(spark):
    df = spark.createDataFrame([("s1", "m"), ("s1", "f"), ("s2", "m"), ("s2", None)], "site string, sex string")
    rows = describe.level_frequency(df, ["sex"]).collect()
    overall = {r.level: r.n for r in rows if r.site is None}
    assert overall == {"m": 2, "f": 1, None: 1}
    assert sum(r.n for r in rows if r.site is not None) == 4
