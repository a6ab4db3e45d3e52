"""Labels whose vectors lie close together: pairs of cells are accepted, not shipped."""

import numpy as np
import pytest

from cohortwise.llm import embedding_dedup


def around(rng, centre, n, spread):
    return centre + spread * rng.normal(size=(n, len(centre)))


def brute(vectors, labels, threshold):
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    linked = (unit @ unit.T >= threshold) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(linked, False)
    component = np.arange(len(vectors))
    while True:
        least = np.minimum(component, np.where(linked, component[None, :], len(vectors)).min(1))
        if (least == component).all():
            return linked.sum(1), component
        component = least


@pytest.mark.parametrize("kind", ["float", "double"])
def test_dense_label(spark, kind):
    rng = np.random.default_rng(3)
    base = rng.normal(size=8)
    vectors = np.concatenate([around(rng, base, 150, 0.001), around(rng, base, 60, 0.06), around(rng, -base, 80, 0.001), around(rng, base, 40, 0.5)])
    vectors = np.concatenate([vectors, vectors[:20]]).astype(np.float32 if kind == "float" else np.float64)
    labels = np.array(["x"] * len(vectors))
    labels[200:210] = "y"
    table = spark.createDataFrame([(i, l, v.tolist()) for i, (l, v) in enumerate(zip(labels.tolist(), vectors.astype(np.float64)))], f"vec_id long, label string, embedding array<{kind}>")
    links, components = brute(vectors.astype(np.float64), labels, 0.98)
    for r in embedding_dedup.near_vectors(table, 0.98, 20).collect():
        assert (r.n_links, r.component_id) == (links[r.vec_id], components[r.vec_id])


def test_a_tight_label_ships_no_vectors(spark):
    rng = np.random.default_rng(4)
    tight = around(rng, rng.normal(size=8), 300, 0.0005)
    members = spark.createDataFrame([(i, 1, v.tolist(), "8|x") for i, v in enumerate(tight)], "id long, weight long, vector array<double>, cell string")
    _, pairs, accepted = embedding_dedup._cells(members, 0.98, 20)
    assert pairs.isEmpty()
    counts = {r.a: r.n for r in accepted.where("b is null").groupBy("a").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert counts == {i: 299 for i in range(300)}
    assert accepted.count() < 300 * 2 + 2000
