"""Feature table for the daily regression.

Inputs are daily tables: one row per series and date, so every window below is bounded by the calendar.
All windows by series share one sort; those by series and weekday (or cluster) reuse its shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.config import DATE, EXCLUDED_FROM_MODEL, SAME_DAY_COLUMNS, SERIES, TARGET
from hourloom.functions.calendar import as_int, cycle, day_of_week, is_weekend, season
from hourloom.operators.clean import impute_mode
from hourloom.operators.resample import fill_steps

LAGS = (1, 2, 3, 7, 14)


def by_date(*keys: str):
    return Window.partitionBy(SERIES, *keys).orderBy(DATE)


def _before(rows: int):
    """The given number of rows before the current one."""
    return by_date().rowsBetween(-rows, -1)


def calendar_features(daily: DataFrame) -> DataFrame:
    d = F.col(DATE)
    dow_sin, dow_cos = cycle(day_of_week(d), 7)
    month_sin, month_cos = cycle(F.month(d), 12)
    return daily.withColumns(
        {
            "day_of_week": day_of_week(d),
            "day_of_month": F.dayofmonth(d),
            "month": F.month(d),
            "quarter": F.quarter(d),
            "week_of_year": F.weekofyear(d),
            "is_weekend": is_weekend(d),
            "is_month_start": as_int(F.dayofmonth(d) == 1),
            "is_month_end": as_int(F.last_day(d) == d),
            "season": season(d),
            "day_of_week_sin": dow_sin,
            "day_of_week_cos": dow_cos,
            "month_sin": month_sin,
            "month_cos": month_cos,
        }
    )


def lag_columns(target: str = TARGET) -> dict[str, Column]:
    lags = {f"lag_{k}d": F.lag(target, k).over(by_date()) for k in LAGS}
    return {**lags, "same_day_last_week": F.lag(target, 7).over(by_date())}


def rolling_columns(target: str = TARGET) -> dict[str, Column]:
    """Statistics of the preceding rows; the current row is never part of them."""
    week, month = _before(7), _before(30)
    return {
        "last_week_avg": F.avg(target).over(week),
        "last_2weeks_avg": F.avg(target).over(_before(14)),
        "rolling_7d_mean": F.avg(target).over(week),
        "rolling_7d_std": F.stddev_samp(target).over(week),
        "rolling_7d_min": F.min(target).over(week),
        "rolling_7d_max": F.max(target).over(week),
        "rolling_30d_mean": F.avg(target).over(month),
        "rolling_30d_std": F.stddev_samp(target).over(month),
    }


def trend_columns(target: str = TARGET) -> dict[str, Column]:
    first_day = F.min(DATE).over(by_date().rowsBetween(Window.unboundedPreceding, 0))
    return {
        "day_number": F.datediff(F.col(DATE), first_day),
        "trend_7d": F.lag(target, 1).over(by_date()) - F.lag(target, 8).over(by_date()),
    }


def ratio_columns(target: str = TARGET) -> dict[str, Column]:
    return {"ratio_to_weekly_avg": F.lag(target, 1).over(by_date()) / (F.avg(target).over(_before(7)) + 1e-6)}


def auxiliary_columns(measure: str = "Voltage_mean") -> dict[str, Column]:
    return {"voltage_avg": F.col(measure), "voltage_7d_avg": F.avg(measure).over(_before(7))}


def group_mean(target: str, key: str, leak_free: bool) -> Column:
    """Mean target of the rows sharing `key`; leak-free looks only at earlier rows."""
    if leak_free:
        return F.avg(target).over(by_date(key).rowsBetween(Window.unboundedPreceding, -1))
    return F.avg(target).over(Window.partitionBy(SERIES, key))


def weekday_mean(daily: DataFrame, target: str = TARGET, leak_free: bool = True) -> DataFrame:
    return daily.withColumn("dow_typical_consumption", group_mean(target, "day_of_week", leak_free))


def join_clusters(daily: DataFrame, clusters: DataFrame) -> DataFrame:
    """Cluster of the same date; days without a profile get the series' most frequent cluster."""
    joined = daily.join(clusters.select(SERIES, DATE, "cluster"), [SERIES, DATE], "left")
    return impute_mode(joined, "cluster", fallback=0)


def cluster_mean(daily: DataFrame, target: str = TARGET, leak_free: bool = True) -> DataFrame:
    return daily.withColumn("cluster_avg_consumption", group_mean(target, "cluster", leak_free))


def yesterday_cluster(daily: DataFrame) -> DataFrame:
    previous = F.lag("cluster", 1).over(by_date())
    return daily.withColumn("yesterday_cluster", F.coalesce(previous, F.col("cluster")))


def on_every_date(daily: DataFrame) -> DataFrame:
    """Adds the dates missing between a series' rows, with null values."""
    return fill_steps(daily, DATE, "1 DAY")


def build_features(
    daily: DataFrame,
    clusters: DataFrame | None = None,
    target: str = TARGET,
    leak_free: bool = True,
    calendar_days: bool = False,
) -> DataFrame:
    """All features. Lags count rows unless `calendar_days` puts every date on the table first."""
    table = on_every_date(daily) if calendar_days else daily
    if clusters is not None:
        table = join_clusters(table, clusters)
    table = calendar_features(table)
    columns = {**lag_columns(target), **rolling_columns(target), **trend_columns(target), **ratio_columns(target)}
    if "Voltage_mean" in daily.columns:
        columns |= auxiliary_columns()
    if clusters is not None:
        columns["yesterday_cluster"] = F.coalesce(F.lag("cluster", 1).over(by_date()), F.col("cluster"))
    table = table.withColumns(columns)
    table = weekday_mean(table, target, leak_free)
    return table if clusters is None else cluster_mean(table, target, leak_free)


def model_inputs(columns: Sequence[str], leak_free: bool = True) -> list[str]:
    """Feature columns in table order: keys, target and excluded names are left out."""
    out = {SERIES, DATE, *EXCLUDED_FROM_MODEL, *(SAME_DAY_COLUMNS if leak_free else ("n_hours", "isolation_score"))}
    return [c for c in columns if c not in out]
