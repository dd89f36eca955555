import numpy as np
import pytest
from helpers import profile_frame
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from hourloom.config import KMeansConfig
from hourloom.operators import cluster, kmeans


def grid_points(spark, values, partitions):
    rows = [((np.rint(np.asarray(v, dtype=float) * kmeans.GRID) / kmeans.GRID).tolist(),) for v in values]
    return spark.createDataFrame(rows, "point array<double>").repartition(partitions).persist()


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(5)
    hearts = rng.normal(0, 4, (6, 5))
    return np.concatenate([h + rng.normal(0, 0.7, (40, 5)) for h in hearts])


def lloyd(points, centers, steps=500):
    for _ in range(steps):
        labels = ((points[:, None] - centers) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([points[labels == c].mean(axis=0) if (labels == c).any() else centers[c] for c in range(len(centers))])
        if (((moved - centers) ** 2).sum(axis=1) <= 1e-8).all():
            return moved
        centers = moved
    return centers


def test_joint_runs_equal_single_fits_from_the_same_starts(spark, cloud):
    points = grid_points(spark, cloud, 3)
    exact = np.array([r["point"] for r in points.collect()])
    config = KMeansConfig(restarts=20)
    fits = kmeans.fit_runs(points, [4, 6], config)
    sample, weights = kmeans.start_points(points, config.start_rows, config.seed)
    assert len(sample) == len(np.unique(exact, axis=0)) and weights.sum() == len(exact)
    for k in (4, 6):
        costs = []
        for restart in range(20):
            start = kmeans.draw_start(sample, k, restart, config.seed)
            assert len(np.unique(start, axis=0)) == k
            centers = lloyd(exact, start)
            costs.append(((exact[:, None] - centers) ** 2).sum(axis=2).min(axis=1).sum())
        assert fits[k].cost == pytest.approx(min(costs), rel=1e-6)
        assert fits[k].counts.sum() == len(cloud)
    model = min((KMeans(k=6, seed=s, featuresCol="v").fit(points.select(array_to_vector("point").alias("v"))) for s in range(5)), key=lambda m: m.summary.trainingCost)
    assert fits[6].cost <= model.summary.trainingCost * (1 + 1e-6)


def test_starts_from_a_small_sample_end_at_centres_that_rest_on_all_points(spark, cloud):
    copies = np.concatenate([cloud, np.repeat(cloud[:3], 200, axis=0)])  # a few points hold most rows
    points = grid_points(spark, copies, 4)
    exact = np.array([r["point"] for r in points.collect()])
    fit = kmeans.fit_runs(points, [6], KMeansConfig(restarts=5, start_rows=25))[6]
    np.testing.assert_allclose(lloyd(exact, fit.centers, steps=1), fit.centers, atol=1e-4)
    assert fit.counts.sum() == len(copies)


def test_partitions_and_order_change_nothing(spark, cloud):
    found = [kmeans.fit_runs(grid_points(spark, rows, n), [5], KMeansConfig(restarts=4))[5] for rows, n in ((cloud, 1), (cloud[::-1], 7))]
    np.testing.assert_array_equal(found[0].centers, found[1].centers)
    assert found[0].cost == found[1].cost and found[0].restart == found[1].restart


def test_silhouettes_equal_the_evaluator_and_a_lone_point_counts_zero(spark, cloud):
    points = grid_points(spark, [*cloud, [90.0] * 5], 3)
    fits = kmeans.fit_runs(points, [2, 7], KMeansConfig(restarts=3))
    for k, score in zip((2, 7), kmeans.silhouettes(points, [fits[2], fits[7]])):
        nearest = {tuple(r["point"]): int(((np.array(r["point"]) - fits[k].centers) ** 2).sum(axis=1).argmin()) for r in points.collect()}
        rows = spark.createDataFrame([(list(p), float(c)) for p, c in nearest.items()], "p array<double>, c double")
        expected = ClusteringEvaluator(featuresCol="v", predictionCol="c").evaluate(rows.select(array_to_vector("p").alias("v"), "c"))
        assert score == pytest.approx(expected, rel=1e-8)


def test_repeated_profiles_give_fewer_clusters_and_broken_ones_none(spark):
    rows = [("a", d, [float(d % 2)] * 4) for d in range(40)] + [("a", 50, [1.0])]
    profiles = profile_frame(spark, rows).unionByName(profile_frame(spark, [("b", 1, [0.0, 0.0, 0.0, float("nan")])]))
    nulls = profiles.limit(1).withColumn("profile", F.lit(None).cast("array<double>")).withColumn("series_id", F.lit("c"))
    fit = cluster.fit_profile_clusters(profiles.unionByName(nulls), 5, KMeansConfig(restarts=2))
    np.testing.assert_allclose(fit.centers, [[0.0] * 4, [1.0] * 4], atol=1e-6)  # the grid
    assert fit.cost == 0
    labels = fit.assign(profiles.unionByName(nulls)).groupBy("cluster").count().collect()
    assert {r["cluster"]: r["count"] for r in labels} == {0: 20, 1: 20, None: 3}
    constant = cluster.fit_profile_clusters(profile_frame(spark, [("a", d, [2.0, 3.0]) for d in range(3)]), 2, KMeansConfig(restarts=1))
    assert constant.centers == [[2.0, 3.0]]
    with pytest.raises(ValueError):
        cluster.fit_profile_clusters(nulls, 2)


def test_a_step_is_one_job(spark, cloud):
    held = kmeans.packed(grid_points(spark, cloud, 3)).persist()
    assert held.count() == 3
    runs = [kmeans.Run(k, 0, cloud[:k]) for k in (3, 6)]
    spark.sparkContext.setJobGroup("steps", "k-means steps")
    for _ in range(4):
        kmeans._step(held, runs, 0.0)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    held.unpersist()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("steps")) == 4


def test_members_are_the_nearest_centres_of_every_run_and_ties_go_to_the_first():
    rng = np.random.default_rng(2)
    points = rng.integers(-3, 4, (700, 3)).astype(float)
    centers = rng.integers(-3, 4, (11, 3)) / 2  # many ties
    centers[4] = centers[2]
    sizes = [2, 3, 3, 1, 2]
    starts = [0, 2, 5, 8, 9, 11]
    member, least = kmeans.members(np.column_stack([points, np.ones(700), (points**2).sum(axis=1)]), centers, sizes)
    for run, (a, b) in enumerate(zip(starts, starts[1:])):
        apart = ((points[:, None] - centers[a:b]) ** 2).sum(axis=2)
        np.testing.assert_array_equal(member[a:b].T, np.eye(b - a)[apart.argmin(axis=1)])
        np.testing.assert_array_equal(least[run], apart.min(axis=1))


def test_packed_points_and_sums_of_many_partitions_lose_nothing(spark):
    rng = np.random.default_rng(3)
    values = [*rng.normal(0, 1, (90, 4)), *rng.normal(0, 3000, (30, 4))]  # the far ones do not fit four bytes
    points = grid_points(spark, values, 3 * kmeans.SUMS_AT_ONCE)
    exact = np.array([r["point"] for r in points.collect()])
    held = kmeans.packed(points)
    assert {m.dtype.itemsize for m in held.collect()} == {4, 8}
    assert sorted(map(tuple, np.concatenate([m / kmeans.GRID for m in held.collect()]))) == sorted(map(tuple, exact))
    runs = [kmeans.Run(k, 0, exact[:k].copy()) for k in (2, 5)]
    counts, sums, _, costs = kmeans._sums(held, runs)
    for run, cost, a in zip(runs, costs, (0, 2)):
        apart = ((exact[:, None] - run.centers) ** 2).sum(axis=2)
        own = np.eye(run.k)[apart.argmin(axis=1)]
        np.testing.assert_array_equal(counts[a : a + run.k], own.sum(axis=0))
        np.testing.assert_array_equal(sums[a : a + run.k], own.T @ (exact * kmeans.GRID))
        assert cost == pytest.approx(apart.min(axis=1).sum())
