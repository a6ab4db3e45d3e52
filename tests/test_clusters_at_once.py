"""k-means of many fits in one pass and medoid clusters, against NumPy and exhaustive search."""

import itertools

import numpy as np
import pytest

from cohortwise.operators import lloyd, medoids, patterns

BINS = {"a": 12, "b": 70}


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(6)
    matrices = {s: np.vstack([rng.random((30, n)) < p for p in (0.95, 0.5, 0.03)]).astype(int) for s, n in BINS.items()}
    matrices["a"][60:] = 0  # a third of all rows alike
    rows = []
    for s, m in matrices.items():
        for i, v in enumerate(m):
            words = [int(np.array(sum(int(b) << j for j, b in enumerate(v[w : w + 64])), np.uint64).astype(np.int64)) for w in range(0, len(v), 64)]
            rows.append((i, s, words))
    return matrices, spark.createDataFrame(rows, "p_id int, stream string, words array<long>").repartition(5)


def test_bits(table):
    matrices, rows = table
    for s, n in BINS.items():
        got = {r.p_id: r.words for r in rows.where(f"stream = '{s}'").collect()}
        assert (patterns.bits(np.array([got[i] for i in range(90)]), n) == matrices[s]).all()


def plain_lloyd(x, centers):
    seen = None
    while True:
        label = lloyd.nearest(x.astype(float), centers)
        if seen is not None and (label == seen).all():
            return label, centers
        seen = label
        centers = np.stack([x[label == c].mean(0) if (label == c).any() else centers[c] for c in range(len(centers))])


def test_all_fits_equal_separate_ones(table):
    matrices, rows = table
    weighted = patterns.weighted_patterns(rows)
    given = {s: m[[0, 40, 80]].astype(float) for s, m in matrices.items()}
    for fit in lloyd.fit_all(weighted, BINS, [3], centers=given):
        label, centers = plain_lloyd(matrices[fit.stream], given[fit.stream])
        assert fit.centers == pytest.approx(centers) and fit.weights.tolist() == np.bincount(label, minlength=3).tolist()
        assert fit.wss == pytest.approx(((matrices[fit.stream] - centers[label]) ** 2).sum())
        placed = lloyd.assign(rows, {fit.stream: fit}, BINS).collect()
        assert {r.p_id: r.raw_cluster for r in placed} == dict(enumerate(label.tolist()))
        assert {r.raw_cluster: r.cluster for r in placed} == {c: fit.names()[c] for c in set(label.tolist())}
    fits = lloyd.fit_all(weighted, BINS, range(1, 6), starts=3, seed=2)
    assert len(fits) == 2 * 3 * 5
    for fit in fits:  # fixed points
        label, centers = plain_lloyd(matrices[fit.stream], fit.centers)
        assert fit.centers == pytest.approx(centers)
    best = lloyd.best(fits)
    for s, m in matrices.items():
        assert best[s, 1].wss == pytest.approx(((m - m.mean(0)) ** 2).sum())
        assert all(best[s, k + 1].wss <= best[s, k].wss + 1e-9 for k in range(1, 5))


def test_the_rows_may_be_dealt_in_any_way(table):
    _, rows = table
    one, other = (lloyd.curve(rows, lloyd.fit_all(patterns.weighted_patterns(part), BINS, [2, 4], seed=3)).collect() for part in (rows, rows.repartition(1)))
    assert sorted(one) == sorted(other)


def test_fewer_patterns_than_clusters(spark):
    rows = spark.createDataFrame([(i, "a", [5 if i % 2 else 0]) for i in range(9)], "p_id int, stream string, words array<long>")
    weighted = patterns.weighted_patterns(rows)
    assert {f.k: round(f.wss, 9) for f in lloyd.fit_all(weighted, {"a": 3}, [1, 2, 4])} == {1: pytest.approx(2 * (4 - 16 / 9)), 2: 0.0, 4: 0.0}
    found = medoids.fit_medoids(weighted, {"a": 3}, 4)
    assert [(f.k, f.cost, f.wss) for f in found[1:]] == [(2, 0.0, 0.0)]
    assert lloyd.fit_all(weighted.limit(0), {"a": 3}, [2]) == [] and medoids.fit_medoids(weighted.limit(0), {"a": 3}, 2) == []


@pytest.mark.parametrize("block", [2048, 7])
def test_medoids(table, block):
    """Small blocks and one block agree; one medoid and clear groups are found as by exhaustive search; no swap is left."""
    matrices, rows = table
    weighted = patterns.weighted_patterns(rows)
    fits = medoids.fit_medoids(weighted, BINS, 4, block)
    for fit in fits:
        m = matrices[fit.stream]
        apart = np.sqrt((m[:, None, :] != m[None, :, :]).sum(2))
        chosen = patterns.bits(fit.words, BINS[fit.stream])
        at = [int(np.flatnonzero((m == c).all(1))[0]) for c in chosen]
        cost = apart[:, at].min(1).sum()
        assert fit.cost == pytest.approx(cost)
        label = apart[:, at].argmin(1)
        assert fit.wss == pytest.approx(sum(((m[label == c] - m[label == c].mean(0)) ** 2).sum() for c in range(fit.k)))
        swapped = min(apart[:, [*at[:j], h, *at[j + 1 :]]].min(1).sum() for j in range(fit.k) for h in range(len(m)))
        assert swapped >= cost - 1e-6
        if fit.k <= 2:
            assert cost == pytest.approx(min(apart[:, list(c)].min(1).sum() for c in itertools.combinations(range(len(m)), fit.k)))
    shown = medoids.medoid_table(rows, fits, BINS).collect()
    assert sum(r["size"] for r in shown if r.k == 3) == 180 and {len(r.medoid) for r in shown if r.stream == "b"} == {70}
