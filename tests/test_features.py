import datetime as dt

import numpy as np
import pandas as pd
import pytest
from helpers import DAY0, daily_frame

from hourloom.operators import features


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    values = {"a": list(rng.normal(20, 3, 60)), "b": list(rng.normal(5, 1, 9)), "c": [1.0]}
    built = features.build_features(daily_frame(spark, values), leak_free=True).toPandas()
    return values, {k: g.sort_values("date").reset_index(drop=True) for k, g in built.groupby("series_id")}


def test_windows_equal_pandas(table):
    values, built = table
    for name, got in built.items():
        y = pd.Series(values[name])
        for lag in features.LAGS:
            np.testing.assert_allclose(got[f"lag_{lag}d"], y.shift(lag))
        for n in (7, 30):
            roll = y.rolling(n, min_periods=1)
            np.testing.assert_allclose(got[f"rolling_{n}d_mean"], roll.mean().shift(1))
            np.testing.assert_allclose(got[f"rolling_{n}d_std"], roll.std().shift(1))
        np.testing.assert_allclose(got["rolling_7d_min"], y.rolling(7, min_periods=1).min().shift(1))
        np.testing.assert_allclose(got["last_2weeks_avg"], y.rolling(14, min_periods=1).mean().shift(1))
        np.testing.assert_allclose(got["trend_7d"], y.shift(1) - y.shift(8))
        np.testing.assert_allclose(got["ratio_to_weekly_avg"], y.shift(1) / (got["rolling_7d_mean"] + 1e-6))
        dow = pd.Series([(DAY0 + dt.timedelta(days=i)).weekday() for i in range(len(y))])
        np.testing.assert_allclose(got["dow_typical_consumption"], y.groupby(dow).transform(lambda s: s.expanding().mean().shift(1)))
        assert list(got["day_number"]) == list(range(len(y)))


def test_calendar(table):
    got = table[1]["a"]
    at = pd.DatetimeIndex(got["date"])
    assert list(got["day_of_week"]) == list(at.dayofweek)
    assert list(got["week_of_year"]) == list(at.isocalendar().week)
    assert list(got["is_month_end"]) == list(at.is_month_end.astype(int))
    assert list(got["is_month_start"]) == list(at.is_month_start.astype(int))
    assert list(got["season"]) == list(at.month % 12 // 3)
    np.testing.assert_allclose(got["month_sin"], np.sin(2 * np.pi * at.month / 12))


def test_rows_or_calendar_days(spark):
    daily = daily_frame(spark, {"a": [1.0, 2.0, 3.0, 4.0]}).where("date != '2020-01-08'")
    by_row = features.build_features(daily).where("date = '2020-01-09'").first()
    by_day = features.build_features(daily, calendar_days=True).where("date = '2020-01-09'").first()
    assert by_row["lag_1d"] == 2.0 and by_day["lag_1d"] is None and by_day["lag_2d"] == 2.0


def test_clusters_join_by_date_and_fill(spark):
    daily = daily_frame(spark, {"a": [1.0, 2.0, 3.0, 4.0]})
    clusters = spark.createDataFrame([("a", DAY0 + dt.timedelta(days=1), 2), ("a", DAY0 + dt.timedelta(days=2), 2)], "series_id string, date date, cluster int")
    rows = features.build_features(daily, clusters, leak_free=False).orderBy("date").collect()
    assert [r["cluster"] for r in rows] == [2, 2, 2, 2]
    assert rows[0]["yesterday_cluster"] == 2
    assert rows[0]["cluster_avg_consumption"] == 2.5


def test_leak_free_inputs_have_no_same_day_columns():
    columns = ["series_id", "date", "total_daily_consumption", "lag_1d", "Sub_metering_1_sum", "voltage_avg", "voltage_7d_avg", "cluster", "anomaly_iqr", "Voltage_mean"]
    assert features.model_inputs(columns) == ["lag_1d", "voltage_7d_avg"]
    assert features.model_inputs(columns, leak_free=False) == ["lag_1d", "Sub_metering_1_sum", "voltage_avg", "voltage_7d_avg", "cluster", "anomaly_iqr"]


def test_all_series_windows_share_one_sort(spark):
    plan = features.build_features(daily_frame(spark, {"a": [1.0, 2.0]}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
