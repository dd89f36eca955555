"""Dense hourly rollup, daily summary and day profiles.

Raw rows are aggregated map-side into hours first. Everything after that holds at most one row per
series and hour (or date), so grouping it by series is bounded by the calendar, not by the raw data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourloom.config import DATE, HOUR_TS, MEAN_MEASURES, SERIES, SUM_MEASURES, TS
from hourloom.functions.calendar import day_metadata, day_of_week, is_weekend, season, truncate
from hourloom.functions.vectors import ordered_values, slots


def hourly_rollup(readings: DataFrame, drop_empty: bool = False) -> DataFrame:
    """One row per hour between a series' first and last reading.

    Hours without readings keep null means and zero sums (`drop_empty` removes them).
    """
    known = (
        readings.where(F.col(TS).isNotNull())
        .groupBy(SERIES, truncate("hour", F.col(TS)).alias(HOUR_TS))
        .agg(
            *[F.avg(m).alias(m) for m in MEAN_MEASURES],
            *[F.coalesce(F.sum(m), F.lit(0.0)).alias(m) for m in SUM_MEASURES],
            F.count("*").alias("n_readings"),
        )
    )
    return known if drop_empty else fill_empty_hours(known)


def fill_steps(known: DataFrame, ts: str, step: str) -> DataFrame:
    """Adds the time steps missing after each known row, with nulls; no spine table, no join."""
    interval = F.expr(f"INTERVAL {step}")
    following = F.lead(ts).over(Window.partitionBy(SERIES).orderBy(ts))
    last_empty = F.greatest(F.coalesce(following - interval, F.col(ts)), F.col(ts))
    steps = known.withColumn("_last", last_empty).select(
        "*", F.explode(F.sequence(F.col(ts), F.col("_last"), interval)).alias("_step")
    )
    real = F.col("_step") == F.col(ts)
    rest = [c for c in known.columns if c not in (SERIES, ts)]
    return steps.select(SERIES, F.col("_step").alias(ts), *[F.when(real, F.col(c)).alias(c) for c in rest])


def fill_empty_hours(known: DataFrame) -> DataFrame:
    return fill_steps(known, HOUR_TS, "1 HOUR").na.fill(0.0, list(SUM_MEASURES)).na.fill(0, ["n_readings"])


def with_hour_calendar(hourly: DataFrame) -> DataFrame:
    """Hour, weekday, day, month, year, weekend and season of each hour."""
    at = F.col(HOUR_TS)
    return hourly.withColumns(
        {
            "hour": F.hour(at),
            "day_of_week": day_of_week(at),
            "day_of_month": F.dayofmonth(at),
            "month": F.month(at),
            "year": F.year(at),
            "is_weekend": is_weekend(at),
            "season": season(at),
        }
    )


def daily_summary(hourly: DataFrame) -> DataFrame:
    """Daily statistics of the hourly table; `n_hours` counts hours with a power reading."""
    power = "Global_active_power"
    daily = hourly.groupBy(SERIES, F.to_date(HOUR_TS).alias(DATE)).agg(
        F.avg(power).alias("avg_hourly_consumption"),
        F.stddev_samp(power).alias("consumption_volatility"),
        F.min(power).alias("min_consumption"),
        F.max(power).alias("peak_consumption"),
        F.coalesce(F.sum(power), F.lit(0.0)).alias("total_daily_consumption"),
        F.avg("Global_reactive_power").alias("Global_reactive_power_mean"),
        F.coalesce(F.sum("Global_reactive_power"), F.lit(0.0)).alias("Global_reactive_power_sum"),
        F.avg("Voltage").alias("Voltage_mean"),
        F.stddev_samp("Voltage").alias("Voltage_std"),
        F.avg("Global_intensity").alias("Global_intensity_mean"),
        F.max("Global_intensity").alias("Global_intensity_max"),
        *[F.coalesce(F.sum(m), F.lit(0.0)).alias(f"{m}_sum") for m in SUM_MEASURES],
        F.count(power).alias("n_hours"),
    )
    day = F.col(DATE)
    return daily.withColumns({**day_metadata(day), "year": F.year(day)})


def slot_profiles(cells: DataFrame, slot: str, value: str, n_slots: int) -> DataFrame:
    """Complete profiles only: `profile` holds the mean value of slots 0..n-1 of a (series, date)."""
    means = cells.groupBy(SERIES, DATE, slot).agg(F.avg(value).alias("_v"))
    whole = means.where(F.col("_v").isNotNull()).groupBy(SERIES, DATE).agg(
        ordered_values(F.col(slot), F.col("_v")).alias("profile")
    )
    return whole.where(F.size("profile") == n_slots)


def daily_profiles(hourly: DataFrame, value: str = "Global_active_power") -> DataFrame:
    """24-hour profiles of complete days with their day metadata.

    The hourly table has one row per hour, so a day is at most 24 rows and one grouping is enough.
    """
    days = (
        hourly.where(F.col(value).isNotNull())
        .groupBy(SERIES, F.to_date(HOUR_TS).alias(DATE))
        .agg(ordered_values(F.hour(HOUR_TS), F.col(value)).alias("profile"))
        .where(F.size("profile") == 24)
    )
    return days.withColumns(day_metadata(F.col(DATE)))


def attach_metadata(profiles: DataFrame, metadata: DataFrame) -> DataFrame:
    """Left join of per-day metadata."""
    return profiles.join(metadata, [SERIES, DATE], "left")


def profiles_wide(profiles: DataFrame, n_slots: int = 24) -> DataFrame:
    """h0..h23 columns in place of the array."""
    rest = [c for c in profiles.columns if c not in (SERIES, DATE, "profile")]
    return profiles.select(SERIES, DATE, *slots(F.col("profile"), [f"h{i}" for i in range(n_slots)]), *rest)


def profiles_long(profiles: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per (series, date, slot)."""
    return profiles.select(SERIES, DATE, *keep, F.posexplode("profile").alias("hour", "v"))
