import datetime as dt

import numpy as np
import pytest
from helpers import DAY0, profile_frame

from hourloom.config import KMeansConfig
from hourloom.operators import cluster

FAST = KMeansConfig(restarts=2, max_iter=50)
HOURS = np.arange(24)
SHAPES = [np.full(24, 1.0), 2 + 2 * np.exp(-((HOURS - 7) ** 2) / 4), 5 + 3 * np.exp(-((HOURS - 19) ** 2) / 4)]


@pytest.fixture(scope="module")
def shapes(spark):
    rng = np.random.default_rng(0)
    return profile_frame(spark, [("m", d, SHAPES[d % 3] + rng.normal(0, 0.1, 24)) for d in range(90)])


def test_three_shapes_are_found_with_stable_labels(shapes):
    fit = cluster.fit_profile_clusters(shapes, 3, FAST)
    labels = {r["date"]: r["cluster"] for r in fit.assign(shapes).collect()}
    assert all(labels[DAY0 + dt.timedelta(days=d)] == d % 3 for d in range(90))
    again = cluster.fit_profile_clusters(shapes.repartition(5), 3, FAST)
    assert {r["date"]: r["cluster"] for r in again.assign(shapes).collect()} == labels
    np.testing.assert_allclose(fit.centers, SHAPES, atol=0.15)
    assert cluster.cluster_silhouette(shapes, fit) > 0.9


def test_choose_k(shapes):
    k, table = cluster.choose_k(shapes, 6, FAST)
    assert k == 3
    assert [r["k"] for r in table.orderBy("k").collect()] == [2, 3, 4, 5, 6]
    with pytest.raises(ValueError):
        cluster.choose_k(shapes.limit(20), 6, FAST)


def test_elbow_reads_the_candidate_of_the_second_difference():
    assert cluster._elbow([2, 3, 4, 5], [100.0, 20.0, 18.0, 17.0], compat=False) == 3
    assert cluster._elbow([2, 3, 4, 5], [100.0, 20.0, 18.0, 17.0], compat=True) == 4
    assert cluster._elbow([2, 3], [100.0, 20.0], compat=False) == 3


def test_similar_days_equal_brute_force_with_fallback(spark):
    rng = np.random.default_rng(3)
    rows = [("a", d, rng.normal(0, 1, 24), int(rng.integers(0, 3))) for d in range(120)]
    rows += [("b", 0, rng.normal(0, 1, 24), 0), ("b", 1, rng.normal(0, 1, 24), 0), ("b", 2, rng.normal(0, 1, 24), 1)]
    clustered = profile_frame(spark, rows)
    targets = clustered.where("day(date) % 5 = 0 or series_id = 'b'").select("series_id", "date")
    found = {}
    for r in cluster.similar_days(clustered, targets, 4, blocks=3).orderBy("rank").collect():
        found.setdefault((r["series_id"], r["date"]), []).append((r["similar_date"], pytest.approx(r["similarity_distance"])))
    for t in targets.collect():
        series, day, profile, label = next(x for x in rows if x[0] == t["series_id"] and DAY0 + dt.timedelta(days=x[1]) == t["date"])
        pool = [x for x in rows if x[0] == series and x[3] == label and x[1] != day]
        same = [x for x in pool if x[1] % 7 == day % 7]
        best = sorted((float(np.linalg.norm(profile - x[2])), DAY0 + dt.timedelta(days=x[1])) for x in (same or pool))[:4]
        assert found.get((series, t["date"]), []) == [(d, dist) for dist, d in best]


def test_characteristics(spark):
    clustered = profile_frame(spark, [("a", d, [1.0, 3.0, 3.0], 0) for d in range(7)])
    row = cluster.cluster_characteristics(clustered).first()
    assert (row["peak_hour"], row["min_hour"], row["n_days"]) == (1, 0, 7)
    assert row["pct_weekends"] == pytest.approx(200 / 7)
    assert row["volatility"] == pytest.approx(np.std([1, 3, 3]))
    assert cluster.typical_profiles(clustered).first()["profile"] == [1.0, 3.0, 3.0]
