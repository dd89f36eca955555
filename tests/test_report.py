import pytest
from helpers import daily_frame, profile_frame

from hourloom.config import TARGET
from hourloom.operators import report


def test_error_classes_have_closed_ends(spark):
    predicted = [100, 95, 94.9, 90, 85, 80, 79, 0, -50]
    rows = [("a", 100.0, float(p)) for p in predicted] + [("a", 0.0, 5.0)]
    df = spark.createDataFrame(rows, f"series_id string, {TARGET} double, prediction double")
    got = {r["bucket"]: r["n_days"] for r in report.error_buckets(df).collect()}
    assert got == {"0-5%": 2, "5-10%": 2, "10-15%": 1, "15-20%": 1, ">20%": 3}


def test_histogram_density_sums_to_one_and_keeps_the_maximum(spark):
    daily = daily_frame(spark, {"a": [float(i) for i in range(101)], "flat": [2.0, 2.0]})
    rows = report.histogram(daily, TARGET, 10).collect()
    a = [r for r in rows if r["series_id"] == "a"]
    assert sum(r["count"] for r in a) == 101 and max(r["bin"] for r in a) == 9
    assert sum(r["density"] * 10.0 for r in a) == pytest.approx(1.0)
    flat = [r for r in rows if r["series_id"] == "flat"]
    assert [(r["bin"], r["count"]) for r in flat] == [(0, 2)]


def test_trend_needs_a_full_window(spark):
    rows = report.daily_trend(daily_frame(spark, {"a": [float(i) for i in range(40)]})).orderBy("date").collect()
    assert [r["rolling_mean"] for r in rows[:29]] == [None] * 29
    assert rows[29]["rolling_mean"] == pytest.approx(14.5)


def test_sample_is_seeded_and_bounded(spark):
    clustered = profile_frame(spark, [("m", d, [float(d)] * 24, d % 2) for d in range(30)])
    first = sorted((r["cluster"], r["date"]) for r in report.sample_profiles(clustered).collect())
    again = sorted((r["cluster"], r["date"]) for r in report.sample_profiles(clustered.repartition(6)).collect())
    assert first == again and len(first) == 10


def test_methods_side_by_side(spark):
    one = spark.createDataFrame([("a", 1.0, 2.0, 3.0)], "series_id string, mae double, rmse double, r2 double")
    two = spark.createDataFrame([("a", 4.0, 5.0)], "series_id string, mae double, rmse double")
    got = {r["metric"]: (r["forest"], r["seasonal"]) for r in report.compare_methods(one, two, ("forest", "seasonal")).collect()}
    assert got == {"mae": (1.0, 4.0), "rmse": (2.0, 5.0), "r2": (3.0, None)}
