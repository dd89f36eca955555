import numpy as np
import pandas as pd
import pytest
from helpers import full_readings

from hourloom.config import MEAN_MEASURES, MEASURES, SUM_MEASURES
from hourloom.operators import resample
from hourloom.plans import training


@pytest.fixture(scope="module")
def readings(spark):
    rng = np.random.default_rng(1)
    days = list(rng.normal(4, 1, 1440 * 4))
    days[300:360] = [np.nan] * 60
    hole = [np.nan] * len(days)
    frame, df = full_readings(spark, {"a": days, "b": days[:1500] + hole[:3000] + days[4500:]})
    keep = frame["Global_active_power"].notna() | (frame["series_id"] == "a")
    return frame[keep], df.where("series_id = 'a' or Global_active_power is not null")


def test_hourly_equals_pandas_resample_with_empty_hours(spark, readings):
    frame, df = readings
    hourly = resample.hourly_rollup(df).toPandas().sort_values(["series_id", "hour_ts"])
    expected = []
    for name, group in frame.groupby("series_id"):
        g = group.set_index("ts").resample("h").agg({m: "mean" if m in MEAN_MEASURES else "sum" for m in MEASURES})
        expected.append(g.assign(series_id=name))
    expected = pd.concat(expected)
    assert len(hourly) == len(expected)
    for m in MEASURES:
        np.testing.assert_allclose(hourly[m].to_numpy(float), expected[m].to_numpy(float), rtol=1e-9)
    assert (hourly.loc[hourly["n_readings"] == 0, list(SUM_MEASURES)] == 0).all().all()
    assert resample.hourly_rollup(df, drop_empty=True).count() == (hourly["n_readings"] > 0).sum()


def test_daily_keeps_days_without_readings(spark, readings):
    _, df = readings
    daily = resample.daily_summary(resample.hourly_rollup(df)).where("series_id = 'b'").toPandas()
    empty = daily[daily["n_hours"] == 0]
    assert len(empty) == 2
    assert (empty["total_daily_consumption"] == 0.0).all()
    assert empty["avg_hourly_consumption"].isna().all()


def test_only_complete_days_have_a_profile(spark, readings):
    _, df = readings
    hourly, daily, profiles = training.prepare(df, method="drop")
    rows = profiles.where("series_id = 'a'").collect()
    whole = daily.where("series_id = 'a' and n_hours = 24").count()
    assert len(rows) == whole > 0
    assert all(len(r["profile"]) == 24 for r in rows)
    wide = resample.profiles_wide(profiles).where("series_id = 'a'").orderBy("date").first()
    first = min(rows, key=lambda r: r["date"])
    assert [wide[f"h{i}"] for i in range(24)] == first["profile"]
    assert set(MEASURES) < set(hourly.columns)
