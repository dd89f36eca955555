"""Small tables for tests."""

import datetime as dt

import numpy as np
import pandas as pd

from hourloom.config import MEASURES

DAY0 = dt.date(2020, 1, 6)  # a Monday


def minute_frame(spark, series: dict[str, list], start="2020-01-06 22:30:00", step_seconds=None, columns=("Global_active_power",)):
    """Readings from value lists; every measure in `columns` carries the same values."""
    parts = []
    for name, values in series.items():
        gaps = step_seconds[name] if step_seconds else [60] * len(values)
        ts = pd.Timestamp(start) + pd.to_timedelta(np.cumsum(gaps), unit="s")
        parts.append(pd.DataFrame({"series_id": name, "ts": ts, **{c: values for c in columns}}))
    frame = pd.concat(parts, ignore_index=True)
    rows = [
        (r.series_id, r.ts.to_pydatetime(), *[None if pd.isna(getattr(r, c)) else float(getattr(r, c)) for c in columns])
        for r in frame.itertuples()
    ]
    schema = "series_id string, ts timestamp_ntz, " + ", ".join(f"{c} double" for c in columns)
    return frame, spark.createDataFrame(rows, schema)


def full_readings(spark, values_by_series):
    return minute_frame(spark, values_by_series, columns=MEASURES)


def daily_frame(spark, totals: dict[str, list], extra=None, start=DAY0):
    """Daily rows with the target; None becomes null."""
    rows = []
    for name, values in totals.items():
        for i, v in enumerate(values):
            rows.append((name, start + dt.timedelta(days=i), None if v is None else float(v), *(None if e is None else float(e) for e in (extra(i, v) if extra else ()))))
    schema = "series_id string, date date, total_daily_consumption double"
    if extra:
        schema += ", avg_hourly_consumption double, consumption_volatility double, peak_consumption double, min_consumption double"
    return spark.createDataFrame(rows, schema)


def profile_frame(spark, rows):
    """(series, day number, profile[, cluster]) rows with their day metadata."""
    out = []
    for series, day, profile, *cluster in rows:
        d = DAY0 + dt.timedelta(days=int(day))
        out.append((series, d, [float(v) for v in profile], d.weekday(), int(d.weekday() >= 5), d.month, d.month % 12 // 3, *cluster))
    schema = "series_id string, date date, profile array<double>, day_of_week int, is_weekend int, month int, season int"
    if rows and len(rows[0]) > 3:
        schema += ", cluster int"
    return spark.createDataFrame(out, schema)
