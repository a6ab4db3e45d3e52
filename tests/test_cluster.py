"""k-means on weighted patterns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortwise.operators import cluster, grid


@pytest.fixture(scope="module")
def words(spark):
    rng = np.random.default_rng(4)
    matrix = np.vstack([rng.random((40, 12)) < p for p in (0.95, 0.5, 0.05)]).astype(int)
    rows = [(f"p{i}", int(b + 1)) for i in range(len(matrix)) for b in np.flatnonzero(matrix[i])]
    people = spark.createDataFrame([(f"p{i}",) for i in range(len(matrix))], "p_id string")
    return matrix, grid.all_participants(grid.activity_words(spark.createDataFrame(rows, "p_id string, bin int"), 12), people)


def test_wss_of_one_cluster_is_the_total_and_falls(words):
    matrix, df = words
    rows = {r.k: r.wss for r in cluster.wss_curve(df, 12, 5, seed=3, starts=3).collect()}
    assert rows[1] == pytest.approx(((matrix - matrix.mean(0)) ** 2).sum())
    assert all(rows[k + 1] < rows[k] for k in range(1, 5))


def test_cost_counts_every_participant(words):
    matrix, df = words
    placed = {r.p_id: r.raw_cluster for r in cluster.assign_kmeans(df, 12, 3, seed=3, starts=3).collect()}
    label = np.array([placed[f"p{i}"] for i in range(len(matrix))])
    cost = sum(((matrix[label == c] - matrix[label == c].mean(0)) ** 2).sum() for c in set(label))
    assert {r.k: r.wss for r in cluster.wss_curve(df, 12, 3, seed=3, starts=3).collect()}[3] <= cost + 1e-9


def test_labels_go_by_engagement(words):
    matrix, df = words
    placed = {r.p_id: r.cluster for r in cluster.assign_kmeans(df, 12, 3, seed=1).collect()}
    assert len(placed) == 120
    means = {c: np.mean([matrix[int(p[1:])].sum() for p, k in placed.items() if k == c]) for c in ("C1", "C2", "C3")}
    assert means["C1"] > means["C2"] > means["C3"]


def test_rule_clusters(words):
    matrix, df = words
    rows = {r.p_id: r for r in cluster.rule_clusters(df, 12, (9, 4)).collect()}
    for i, row in enumerate(matrix):
        engaged = int(row.sum())
        assert (rows[f"p{i}"].engaged, rows[f"p{i}"].cluster) == (engaged, "C1" if engaged >= 9 else "C2" if engaged >= 4 else "C3")


def test_tag_cluster(words):
    tagged = cluster.tag_cluster(cluster.rule_clusters(words[1], 12, (9, 4)), "C1", "active")
    assert {r.cluster for r in tagged.select(F.col("cluster")).collect()} == {"C1_active"}
