import datetime as dt

import numpy as np
import pytest
from helpers import DAY0, daily_frame, profile_frame

from hourloom.config import AnomalyConfig
from hourloom.operators import anomaly, isolation


def extra(i, v):
    return (v / 24, 1 + (i % 7) * 0.1, v / 10, v / 100)


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(5)
    values = rng.normal(100, 8, 500)
    days = rng.choice(500, 10, replace=False)
    values[days] = rng.choice([5, 260], 10)
    return daily_frame(spark, {"m": list(values)}, extra), {DAY0 + dt.timedelta(days=int(d)) for d in days}


def test_fences_find_planted_days(planted):
    daily, days = planted
    for method, flag, t in (("iqr", "anomaly_iqr", 2.5), ("zscore", "anomaly_zscore", 3.0)):
        found = {r["date"] for r in anomaly.statistical_flags(daily, method=method, threshold=t).where(flag).collect()}
        assert found == days
    with pytest.raises(ValueError):
        anomaly.statistical_flags(daily, method="other")


def test_constant_single_and_null_series_are_never_flagged(spark):
    daily = daily_frame(spark, {"flat": [3.0] * 9, "one": [4.0], "gap": [1.0, None, 1.2, 0.9, 1.1]})
    rows = anomaly.both_statistical_flags(daily).collect()
    assert len(rows) == 15
    assert not any(r["anomaly_iqr"] or r["anomaly_zscore"] for r in rows)
    assert all(r["anomaly_iqr"] is not None for r in rows)


def test_pattern_deviation_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [("a", d, rng.normal(2, 1, 24)) for d in range(80)] + [("b", d, rng.normal(2, 1, 24)) for d in range(24)]
    rows[10] = ("a", 10, np.full(24, 30.0))
    got = {(r["series_id"], r["date"]): r for r in anomaly.pattern_deviation(profile_frame(spark, rows)).collect()}
    for series, day, profile in rows:
        peers = np.array([p for s, d, p in rows if s == series and d != day and d % 7 == day % 7])
        row = got[series, DAY0 + dt.timedelta(days=day)]
        if len(peers) < 3:
            assert row["max_deviation"] is None and row["anomaly_pattern"] is False
            continue
        expected = (np.abs(profile - peers.mean(0)) / (peers.std(0, ddof=1) + 1e-6)).max()
        assert row["max_deviation"] == pytest.approx(expected, rel=1e-7)
        assert row["anomaly_pattern"] == (expected > 2.5)


def test_isolation_ranks_planted_days_first_whatever_the_partitioning(planted):
    daily, days = planted
    one = isolation.isolation_flags(daily.coalesce(1))
    many = isolation.isolation_flags(daily.repartition(7, "date"))
    scores = {r["date"]: r["isolation_score"] for r in one.collect()}
    assert scores == {r["date"]: r["isolation_score"] for r in many.collect()}
    assert set(sorted(scores, key=scores.get)[:10]) == days
    assert one.where("anomaly_isolation_forest").count() == 25
    assert all(-1 <= s < 0 for s in scores.values())


def test_isolation_survives_tiny_and_null_series(spark):
    daily = daily_frame(spark, {"one": [1.0], "two": [1.0, 2.0]}, lambda i, v: (None, None, v, v))
    assert isolation.isolation_flags(daily).count() == 3


def test_four_way_vote_and_summary(spark, planted):
    daily, days = planted
    rng = np.random.default_rng(2)
    profiles = profile_frame(spark, [("m", d, rng.normal(2, 0.1, 24) + (40 if DAY0 + dt.timedelta(days=d) in days else 0)) for d in range(0, 500, 2)])
    flagged = anomaly.detect_anomalies(daily, profiles, AnomalyConfig()).cache()
    voted = {r["date"] for r in flagged.where("is_anomaly").collect()}
    assert days <= voted
    summary = anomaly.anomaly_summary(flagged).first()
    assert summary["total_days"] == 500 and summary["anomalies_detected"] == len(voted)
    assert anomaly.clean_days(flagged).count() == 500 - len(voted)
    counts = {r["method"]: r["n_days"] for r in anomaly.method_counts(flagged).collect()}
    assert counts["iqr"] == 10 and counts["isolation_forest"] == 25
    with pytest.raises(ValueError):
        anomaly.clean_days(daily)


def test_isolation_gives_back_the_same_rows(spark):
    """Rows without a date or a series, repeated rows and extra columns with the names used inside."""
    rng = np.random.default_rng(4)
    rows = [(s, DAY0 + dt.timedelta(days=d) if d != 3 else None, float(rng.normal(10, 1)) if d != 5 else None, d, "x") for s in ("a", None) for d in range(16)]
    rows += [rows[0], rows[0]]
    daily = spark.createDataFrame(rows, "series_id string, date date, total_daily_consumption double, tree int, _k2 string").drop("_k2")
    got = isolation.isolation_flags(daily).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == sorted((r[:4] for r in rows), key=str)
    assert all(r["isolation_score"] is not None and r["anomaly_isolation_forest"] is not None for r in got)
    assert isolation.isolation_flags(daily.limit(0)).collect() == []


def test_forest_scores_follow_the_node_tables():
    rng = np.random.default_rng(1)
    values, tree = rng.normal(0, 1, (300, 3)), np.repeat(np.arange(5), 60)
    feature, cut, path, depth = isolation.grow_forest(values, tree, 5, np.random.default_rng(2))
    x = rng.normal(0, 2, (40, 3))
    got = isolation.forest_scores(x, feature, cut, path, depth, 4.5)
    for row, score in zip(x, got):
        total = 0.0
        for t in range(5):
            node = 0
            while feature[t, node] >= 0:
                node = 2 * node + (2 if row[feature[t, node]] > cut[t, node] else 1)
            total += path[t, node]
        assert score == pytest.approx(-(2.0 ** -(total / 5 / 4.5)))
    leaves = feature < 0
    assert leaves[:, -(1 << depth) :].all() and (path[leaves] >= 0).all()


def test_samples_hold_the_least_hashes(spark):
    days = spark.range(5000).selectExpr("concat('s', id % 2) AS _k", "date_add(date'2000-01-01', cast(id as int)) AS date", "array(cast(id as double)) AS _x", "2500L AS _n")
    got = isolation.sampled_days(days, 3, 64, 7)
    counts = {(r["_k"], r["tree"]): r["count"] for r in got.groupBy("_k", "tree").count().collect()}
    assert counts == {(k, t): 64 for k in ("s0", "s1") for t in range(3)}
    again = isolation.sampled_days(days.repartition(5), 3, 64, 7)
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
