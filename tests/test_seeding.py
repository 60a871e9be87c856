"""k-means seeded and settled on all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.operators import cluster, seeding

SCHEMA = "row_id long, features array<double>"


def frame(spark, x, parts=4):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], SCHEMA).repartition(parts)


def blobs(seed, sizes, spread=1.0, gap=40.0):
    rng = np.random.default_rng(seed)
    centres = rng.permutation(len(sizes))[:, None] * np.array([[gap, -gap, gap / 2]])
    return np.concatenate([c + spread * rng.normal(size=(n, 3)) for c, n in zip(centres, sizes)])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_cluster_of_one_row_in_twenty_thousand_is_found(spark, seed):
    x = blobs(seed, [20_000, 19_998, 2], gap=120.0)  # the two rows then cost more than a large group cut in two saves
    model = cluster.fit_kmeans(frame(spark, x, 8), [3], seed=seed)[0]
    near = ((x[:, None, :] - model.centers[None]) ** 2).sum(2).argmin(1)
    assert sorted(np.bincount(near, minlength=3).tolist()) == [2, 19_998, 20_000]
    assert np.isclose(model.cost, ((x - model.centers[near]) ** 2).sum())


def test_same_centres_for_any_partitions(spark):
    x = blobs(4, [300, 200, 100, 50], spread=8.0)
    models = [cluster.fit_kmeans(frame(spark, x, p), [2, 4, 6], n_init=4) for p in (1, 4, 64)]
    for other in models[1:]:
        for a, b in zip(models[0], other):
            assert a.k == b.k and np.allclose(a.centers, b.centers) and np.isclose(a.cost, b.cost)


def test_every_row_weighs(spark):
    """Candidates come from all rows: the far ones are drawn first, whatever the size of the rest."""
    x = np.concatenate([np.zeros((5_000, 2)), np.ones((5_000, 2)) * 0.1, [[500.0, 0.0]], [[0.0, -700.0]]])
    found = seeding.candidates(frame(spark, x, 6), "row_id", "features", 5, 7)
    assert {tuple(r) for r in found} == {(0.0, 0.0), (0.1, 0.1), (500.0, 0.0), (0.0, -700.0)}


def test_cost_is_near_that_of_many_starts(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 4)) + rng.integers(0, 5, size=(600, 1)) * 3
    model = cluster.fit_kmeans(frame(spark, x), [5], n_init=5)[0]
    best = np.inf
    for s in range(20):
        c = x[np.random.default_rng(s).choice(len(x), 5, replace=False)]
        for _ in range(50):
            near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(5)])
        best = min(best, ((x - c[((x[:, None] - c[None]) ** 2).sum(2).argmin(1)]) ** 2).sum())
    assert model.cost <= best * 1.05


def test_copies_ties_and_few_rows(spark):
    same = frame(spark, np.ones((50, 2)))
    model = cluster.fit_kmeans(same, [1, 3], n_init=2)
    assert model[0].cost == model[1].cost == 0.0 and np.allclose(model[1].centers, 1.0)
    two = cluster.fit_kmeans(frame(spark, [[0.0, 0.0], [4.0, 0.0]]), [2, 3], n_init=2)
    assert [m.cost for m in two] == [0.0, 0.0]
    repeated = frame(spark, blobs(6, [60, 40])).withColumn("row_id", F.lit(1).cast("long"))
    assert len(cluster.fit_kmeans(repeated, [2], n_init=2)[0].centers) == 2


def test_steps_from_given_centres(spark):
    x = blobs(7, [50, 70, 30], spread=12.0)
    c = start = x[:3]
    for _ in range(3):
        near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(3)])
    model = cluster.settle(frame(spark, x), [start], max_iter=3, tol=0.0)[0]
    assert np.allclose(model.centers, c)


def test_least_size_counts_empty_clusters(spark):
    """Equal rows leave clusters empty; these are smaller than any bound."""
    best, table = cluster.choose_k(frame(spark, np.ones((40, 2))), 2, 3, min_cluster_rows=1, n_init=1)
    assert best.k == 1 and [r["smallest"] for r in table] == [0, 0]
