"""Bounds of the medoid steps: few candidates are weighed, and the result is that of weighing all."""

import itertools

import numpy as np
import pytest

from cohortwise.operators import medoids

BINS = 40


@pytest.fixture(scope="module")
def sparse(spark):
    rng = np.random.default_rng(5)
    chosen = {tuple(sorted(rng.choice(BINS, size, replace=False).tolist())) for size in rng.integers(0, 6, 700)}
    rows = [("a", [sum(1 << b for b in bits)], float(rng.integers(1, 9))) for bits in sorted(chosen)]
    matrix = np.array([[(words[0] >> b) & 1 for b in range(BINS)] for _, words, _ in rows], float)
    return spark.createDataFrame(rows, "stream string, words array<long>, weight double").cache(), matrix, np.array([w for *_, w in rows])


def plain(matrix, weight, k_max):
    """Costs of greedy build and best swaps with every candidate weighed."""
    apart = np.sqrt((matrix[:, None, :] != matrix[None, :, :]).sum(2))
    built, costs = [], []
    for _ in range(k_max):
        near = apart[:, built].min(1) if built else np.full(len(matrix), np.inf)
        built.append(int(np.argmin(np.round(np.minimum(apart, near[None, :]) @ weight, 7))))
    for k in range(1, k_max + 1):
        ids = built[:k]
        while k > 1:
            cost = apart[:, ids].min(1) @ weight
            swaps = [(round(apart[:, [*ids[:j], h, *ids[j + 1 :]]].min(1) @ weight - cost, 7), j, h) for j, h in itertools.product(range(k), range(len(matrix)))]
            gain, j, h = min(swaps)
            if gain >= -1e-7:
                break
            ids = [*ids[:j], h, *ids[j + 1 :]]
        costs.append(apart[:, ids].min(1) @ weight)
    return costs


def test_few_candidates_are_weighed_and_the_result_is_exact(sparse, monkeypatch):
    patterns, matrix, weight = sparse
    left, rest = [], medoids._rest

    def counted(*args):
        found = rest(*args)
        left.extend(r.n for r in found.collect())
        return found

    monkeypatch.setattr(medoids, "_rest", counted)
    fits = medoids.fit_medoids(patterns, {"a": BINS}, 3, 128)
    assert [f.cost for f in fits] == pytest.approx(plain(matrix, weight, 3))
    steps = 3 + 2 * (max(f.swaps for f in fits) + 1)
    assert sum(left) < 0.2 * steps * len(matrix)


@pytest.mark.parametrize("paired, few", [(0, 1024), (8_000_000, 0), (0, 0)])
def test_bounds_by_single_bins_and_blocks_of_candidates_agree(sparse, monkeypatch, paired, few):
    patterns, matrix, weight = sparse
    monkeypatch.setattr(medoids, "_PAIR_CELLS", paired)
    fits = medoids.fit_medoids(patterns, {"a": BINS}, 2, 128, few)
    assert [f.cost for f in fits] == pytest.approx(plain(matrix, weight, 2))


def test_no_value_lies_below_its_bound():
    rng = np.random.default_rng(1)
    for paired, (size, u) in itertools.product((True, False), itertools.product(range(6), range(6))):
        reach = np.sqrt(rng.integers(0, 12, 50))
        second = np.sqrt(reach**2 + rng.integers(0, 9, 50))
        base, slope, curve, loss, relief = medoids._bent(reach, second, np.full(50, size), u, paired)
        for o in range(min(size, u) + 1):
            apart = np.sqrt(size + u - 2 * o)
            assert (base + o * slope + o * (o - 1) / 2 * curve <= np.minimum(apart, reach) + 1e-12).all()
            assert (loss - o * relief <= np.clip(apart, reach, second) - reach + 1e-12).all()
