import numpy as np
import pandas as pd
import pytest
from helpers import minute_frame

from hourloom.config import GapLimits
from hourloom.operators import clean

POWER = ["Global_active_power"]


def with_gaps(seed, lead, gaps, trail, run=40):
    rng = np.random.default_rng(seed)
    values = [np.nan] * lead
    for gap in gaps:
        values += list(rng.normal(5, 2, run)) + [np.nan] * gap
    return values + list(rng.normal(5, 2, run)) + [np.nan] * trail


def pandas_fill(frame, limit=60, hold=10, back=10):
    out = []
    for _, group in frame.groupby("series_id"):
        s = group.set_index("ts")["Global_active_power"].interpolate(method="time", limit=limit)
        out.append(s.ffill(limit=hold).bfill(limit=back).to_numpy())
    return np.concatenate(out)


def collected(df):
    rows = df.orderBy("series_id", "ts").collect()
    return np.array([np.nan if r["Global_active_power"] is None else r["Global_active_power"] for r in rows])


def test_gap_filler_equals_pandas_across_day_edges(spark):
    series = {
        "a": with_gaps(1, 25, [30, 65, 75, 100, 140], 80),
        "b": with_gaps(2, 5, [1, 60, 61, 70, 71, 72, 80, 81, 200], 0, run=3),
        "c": [np.nan] * 30,
    }
    frame, readings = minute_frame(spark, series)
    np.testing.assert_allclose(collected(clean.interpolate_gaps(readings, POWER)), pandas_fill(frame), rtol=1e-9)


def test_gap_filler_equals_pandas_on_uneven_steps_and_long_gaps_over_days(spark):
    rng = np.random.default_rng(3)
    values = with_gaps(4, 12, [30, 65, 66, 69, 75, 90, 300], 75, run=7)
    steps = {"a": list(rng.integers(30, 4000, len(values)))}
    frame, readings = minute_frame(spark, {"a": values}, step_seconds=steps)
    assert frame["ts"].dt.date.nunique() > 10
    np.testing.assert_allclose(collected(clean.interpolate_gaps(readings, POWER)), pandas_fill(frame), rtol=1e-9)


@pytest.mark.parametrize("limits", [(3, 2, 1), (5, 0, 2), (1, 3, 0)])
def test_limits_are_parameters(spark, limits):
    frame, readings = minute_frame(spark, {"a": with_gaps(5, 4, [1, 3, 5, 8, 12], 9, run=4)})
    expected = []
    for _, group in frame.groupby("series_id"):
        s = group.set_index("ts")["Global_active_power"].interpolate(method="time", limit=limits[0])
        s = s.ffill(limit=limits[1]) if limits[1] else s
        s = s.bfill(limit=limits[2]) if limits[2] else s
        expected.append(s.to_numpy())
    got = collected(clean.interpolate_gaps(readings, POWER, GapLimits(*limits)))
    np.testing.assert_allclose(got, np.concatenate(expected), rtol=1e-9)


def test_max_gap_leaves_longer_gaps_to_the_back_fill(spark):
    _, readings = minute_frame(spark, {"a": [1.0, None, None, None, 5.0, None, 7.0]})
    got = collected(clean.interpolate_gaps(readings, POWER, GapLimits(60, 10, 1, max_gap=1)))
    np.testing.assert_allclose(got, [1, np.nan, np.nan, 5, 5, 6, 7])


def test_forward_fill_equals_pandas(spark):
    frame, readings = minute_frame(spark, {"a": with_gaps(6, 25, [30, 2000, 75], 8), "b": with_gaps(7, 0, [5], 3)})
    expected = frame.groupby("series_id")["Global_active_power"].ffill().to_numpy()
    np.testing.assert_allclose(collected(clean.forward_fill(readings, POWER)), expected)


def test_drop_and_unknown_method(spark):
    _, readings = minute_frame(spark, {"a": [1.0, None, 3.0]})
    assert clean.handle_missing(readings, "drop", POWER).count() == 2
    with pytest.raises(ValueError):
        clean.handle_missing(readings, "guess", POWER)


def test_mode_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 3), ("a", 1), ("a", None), ("b", None)], "series_id string, cluster int")
    rows = clean.impute_mode(df, "cluster", fallback=0).collect()
    assert sorted((r["series_id"], r["cluster"]) for r in rows) == [("a", 1), ("a", 1), ("a", 1), ("a", 3), ("a", 3), ("b", 0)]


def test_zero_fill_adds_missing_columns(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0)], "series_id string, x double")
    rows = clean.zero_fill(df, ["x", "y"]).orderBy("series_id").collect()
    assert [(r["x"], r["y"]) for r in rows] == [(0.0, 0.0), (2.0, 0.0)]
    assert pd.notna(rows[0]["x"])


def test_raw_rows_are_shuffled_once(spark, tmp_path):
    _, readings = minute_frame(spark, {"a": with_gaps(8, 3, [70], 2), "b": [1.0, None, 2.0]})
    readings.write.parquet(str(tmp_path / "r"))
    for fill in (clean.interpolate_gaps, clean.forward_fill):
        filled = fill(spark.read.parquet(str(tmp_path / "r")), POWER)
        filled.collect()
        plan = filled._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "ReusedExchange" in plan


def test_repeated_and_missing_times(spark):
    import datetime as dt

    t = dt.datetime(2020, 1, 6, 1)
    rows = [("a", t, 1.0), ("a", t, None), ("a", t, 3.0), (None, t, None), ("a", None, None), ("a", t + dt.timedelta(minutes=2), 5.0)]
    readings = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, Global_active_power double")
    for fill in (clean.interpolate_gaps, clean.forward_fill):
        results = [sorted(map(str, fill(readings.orderBy(o).coalesce(1), POWER).collect())) for o in ("Global_active_power", "ts", "series_id")]
        assert results[0] == results[1] == results[2] and len(results[0]) == 6
        kept = [r for r in fill(readings, POWER).collect() if r["series_id"] is None or r["ts"] is None]
        assert len(kept) == 2 and all(r["Global_active_power"] is None for r in kept)
