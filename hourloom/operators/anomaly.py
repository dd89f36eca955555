"""Four-way anomaly vote over daily tables (one row per series and date)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.config import ANOMALY_FLAGS, DATE, SERIES, TARGET, AnomalyConfig
from hourloom.functions.stats import with_group_stats
from hourloom.operators.isolation import isolation_flags


def _quartiles(column: str, approximate: bool) -> Column:
    at = F.array(F.lit(0.25), F.lit(0.75))
    return F.percentile_approx(column, at, 10000) if approximate else F.percentile(column, at)


def _outside_fence(value: Column, quartiles: Column, threshold: float) -> Column:
    q1, q3 = quartiles[0], quartiles[1]
    reach = threshold * (q3 - q1)
    return F.coalesce((value < q1 - reach) | (value > q3 + reach), F.lit(False))


def _far_from_mean(value: Column, mean: Column, std: Column, threshold: float) -> Column:
    return F.coalesce(F.abs(F.try_divide(value - mean, std)) > threshold, F.lit(False))


def statistical_flags(
    daily: DataFrame,
    column: str = TARGET,
    method: str = "iqr",
    threshold: float = 3.0,
    approximate: bool = False,
) -> DataFrame:
    """Adds `anomaly_iqr` or `anomaly_zscore`; nulls are ignored and never flagged."""
    value = F.col(column)
    if method == "iqr":
        stats = with_group_stats(daily, [SERIES], {"_q": _quartiles(column, approximate)})
        return stats.withColumn("anomaly_iqr", _outside_fence(value, F.col("_q"), threshold)).drop("_q")
    if method == "zscore":
        stats = with_group_stats(daily, [SERIES], {"_mean": F.avg(column), "_std": F.stddev_pop(column)})
        flag = _far_from_mean(value, F.col("_mean"), F.col("_std"), threshold)
        return stats.withColumn("anomaly_zscore", flag).drop("_mean", "_std")
    raise ValueError(f"unknown method {method!r}")


def both_statistical_flags(daily: DataFrame, config: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    """IQR and z-score flags of the target from one window."""
    stats = with_group_stats(
        daily, [SERIES], {"_q": _quartiles(TARGET, False), "_mean": F.avg(TARGET), "_std": F.stddev_pop(TARGET)}
    )
    value = F.col(TARGET)
    return stats.withColumns(
        {
            "anomaly_iqr": _outside_fence(value, F.col("_q"), config.iqr_threshold),
            "anomaly_zscore": _far_from_mean(value, F.col("_mean"), F.col("_std"), config.zscore_threshold),
        }
    ).drop("_q", "_mean", "_std")


def pattern_deviation(profiles: DataFrame, threshold: float = 2.5, n_slots: int = 24) -> DataFrame:
    """Largest distance of a day's slots from the other days of its weekday, in their deviations.

    The mean and deviation without the day itself follow from the group's count, mean and variance, so
    one window over (series, weekday) replaces the comparison of all pairs of days. Fewer than three
    peers: no deviation, not flagged.
    """
    slots = [F.col("profile")[i] for i in range(n_slots)]
    stats = {"_n": F.count("*")}
    stats |= {f"_mean_{i}": F.avg(x) for i, x in enumerate(slots)}
    stats |= {f"_var_{i}": F.var_pop(x) for i, x in enumerate(slots)}
    grouped = with_group_stats(profiles, [SERIES, "day_of_week"], stats)
    n = F.col("_n").cast("double")

    def deviation(i: int, x: Column) -> Column:
        centred = x - F.col(f"_mean_{i}")
        others_ss = n * F.col(f"_var_{i}") - n / (n - 1) * centred * centred
        others_std = F.sqrt(F.greatest(others_ss, F.lit(0.0)) / (n - 2))
        return F.abs(centred * n / (n - 1)) / (others_std + 1e-6)

    largest = F.greatest(*[deviation(i, x) for i, x in enumerate(slots)])
    scored = grouped.withColumn("max_deviation", F.when(n >= 4, largest)).drop(*stats)
    return scored.withColumn("anomaly_pattern", F.coalesce(F.col("max_deviation") > threshold, F.lit(False)))


def align_flags(daily: DataFrame, flags: DataFrame, column: str) -> DataFrame:
    """Left join of one flag by date; days the method did not see count as normal."""
    joined = daily.join(flags.select(SERIES, DATE, column), [SERIES, DATE], "left")
    return joined.withColumn(column, F.coalesce(F.col(column), F.lit(False)))


def vote(flagged: DataFrame, flags: Sequence[str] = ANOMALY_FLAGS, consensus: int = 2) -> DataFrame:
    """Number of methods that flag a day, and the verdict."""
    count = sum((F.col(c).cast("int") for c in flags), F.lit(0))
    return flagged.withColumn("anomaly_count", count).withColumn("is_anomaly", F.col("anomaly_count") >= consensus)


def detect_anomalies(
    daily: DataFrame, profiles: DataFrame, config: AnomalyConfig = AnomalyConfig()
) -> DataFrame:
    """All four methods and their vote."""
    flagged = both_statistical_flags(daily, config)
    flagged = isolation_flags(flagged, config=config)
    pattern = pattern_deviation(profiles, config.pattern_threshold, config.profile_slots)
    flagged = align_flags(flagged, pattern, "anomaly_pattern")
    return vote(flagged, ANOMALY_FLAGS, config.consensus)


def anomaly_summary(flagged: DataFrame) -> DataFrame:
    """Days, anomalies and percentage per series."""
    hits = F.count_if("is_anomaly")
    return flagged.groupBy(SERIES).agg(
        F.count("*").alias("total_days"),
        hits.alias("anomalies_detected"),
        (hits / F.count("*") * 100).alias("anomaly_percentage"),
    )


def method_counts(flagged: DataFrame, flags: Sequence[str] = ANOMALY_FLAGS) -> DataFrame:
    """Flagged days per series and method, long form."""
    counts = flagged.groupBy(SERIES).agg(*[F.count_if(F.col(c)).alias(c.removeprefix("anomaly_")) for c in flags])
    names = [c.removeprefix("anomaly_") for c in flags]
    return counts.unpivot(SERIES, names, "method", "n_days")


def clean_days(flagged: DataFrame, remove: bool = True) -> DataFrame:
    if "is_anomaly" not in flagged.columns:
        raise ValueError("the table has no anomaly verdict")
    return flagged.where(~F.col("is_anomaly")) if remove else flagged
