"""The tables behind the usual plots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.config import ANOMALY_FLAGS, DATE, SERIES, TARGET
from hourloom.functions.stats import with_group_stats
from hourloom.operators.anomaly import method_counts
from hourloom.operators.model import regression_metrics


def daily_trend(daily: DataFrame, window: int = 30, target: str = TARGET) -> DataFrame:
    """Target, anomaly flag and the mean of the last `window` rows (null until the window is full)."""
    frame = Window.partitionBy(SERIES).orderBy(DATE).rowsBetween(1 - window, 0)
    mean = F.when(F.count(target).over(frame) == window, F.avg(target).over(frame))
    flag = [F.col("is_anomaly")] if "is_anomaly" in daily.columns else []
    return daily.select(SERIES, DATE, F.col(target), *flag, mean.alias("rolling_mean"))


def _mean_by(hourly: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return hourly.groupBy(*keys).agg(F.avg(value).alias("mean"))


def mean_by_hour(hourly: DataFrame, value: str = "Global_active_power") -> DataFrame:
    return _mean_by(hourly, [SERIES, "hour"], value)


def mean_by_hour_and_weekend(hourly: DataFrame, value: str = "Global_active_power") -> DataFrame:
    return _mean_by(hourly, [SERIES, "is_weekend", "hour"], value)


def mean_by_weekday(hourly: DataFrame, value: str = "Global_active_power") -> DataFrame:
    return _mean_by(hourly, [SERIES, "day_of_week"], value)


def mean_by_month(hourly: DataFrame, value: str = "Global_active_power") -> DataFrame:
    return _mean_by(hourly, [SERIES, "month"], value)


def usage_patterns(hourly: DataFrame, value: str = "Global_active_power") -> DataFrame:
    """The four mean tables above from a single pass."""
    sets = [["hour"], ["is_weekend", "hour"], ["day_of_week"], ["month"]]
    keys = [SERIES, "hour", "is_weekend", "day_of_week", "month"]
    means = hourly.groupingSets([[F.col(SERIES), *map(F.col, s)] for s in sets], *keys).agg(F.avg(value).alias("mean"))
    view = (
        F.when(F.col("day_of_week").isNotNull(), "weekday")
        .when(F.col("month").isNotNull(), "month")
        .when(F.col("is_weekend").isNotNull(), "hour_by_weekend")
        .otherwise("hour")
    )
    return means.select(view.alias("view"), *keys, "mean")


def cluster_curves(clustered: DataFrame) -> DataFrame:
    """Mean and sample deviation per cluster and slot, with the number of days."""
    cells = clustered.select("cluster", F.posexplode("profile").alias("hour", "v"))
    return cells.groupBy("cluster", "hour").agg(
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.count("*").alias("n_days")
    )


def sample_profiles(clustered: DataFrame, per_cluster: int = 5, seed: int = 42) -> DataFrame:
    """Up to `per_cluster` profiles of each cluster, picked by a seeded hash.

    Spark limits each group before the shuffle when a row number is compared with a constant.
    """
    key = F.xxhash64(F.col(SERIES), F.col(DATE), F.lit(seed))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(key, SERIES, DATE))
    return clustered.withColumn("_rank", rank).where(F.col("_rank") <= per_cluster).drop("_rank")


def actual_vs_predicted(
    scored: DataFrame, actual: str = TARGET, prediction: str = "prediction", keys: Sequence[str] = (SERIES,)
) -> DataFrame:
    """Metrics per series and the ends of the identity line."""
    ends = [
        F.least(F.min(actual), F.min(prediction)).alias("line_from"),
        F.greatest(F.max(actual), F.max(prediction)).alias("line_to"),
    ]
    return regression_metrics(scored, actual, prediction, keys, ends)


def histogram(df: DataFrame, value: str, bins: Column | int, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Equal-width bins between the group's extremes: count and density per non-empty bin."""
    keys = list(keys)
    n_bins = bins if isinstance(bins, Column) else F.lit(bins)
    rows = df.where(F.col(value).isNotNull())
    ends = {"_lo": F.min(value), "_hi": F.max(value), "_n": F.count("*")}
    placed = with_group_stats(rows, keys, ends).withColumn("_bins", n_bins)
    width = (F.col("_hi") - F.col("_lo")) / F.col("_bins")
    place = F.floor(F.try_divide(F.col(value) - F.col("_lo"), width))
    bin_no = F.least(F.coalesce(place, F.lit(0)), F.col("_bins") - 1).cast("int")
    counted = placed.withColumns({"bin": bin_no, "_width": width}).groupBy(*keys, "bin").agg(
        F.count("*").alias("count"), F.first("_lo").alias("_lo"), F.first("_width").alias("_width"), F.first("_n").alias("_n")
    )
    return counted.select(
        *keys,
        "bin",
        (F.col("_lo") + F.col("bin") * F.col("_width")).alias("bin_from"),
        "count",
        F.try_divide(F.col("count").cast("double"), F.col("_n") * F.col("_width")).alias("density"),
    )


def consumption_histogram(flagged: DataFrame, target: str = TARGET) -> DataFrame:
    """Normal days in 50 bins, anomalous ones in 20."""
    return histogram(flagged, target, F.when(F.col("is_anomaly"), 20).otherwise(50), [SERIES, "is_anomaly"])


def detections_by_method(flagged: DataFrame, flags: Sequence[str] = ANOMALY_FLAGS) -> DataFrame:
    return method_counts(flagged, flags)


def vote_distribution(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy(SERIES, "anomaly_count").agg(F.count("*").alias("n_days"))


def residuals(scored: DataFrame, actual: str = TARGET, prediction: str = "prediction") -> DataFrame:
    """Residual of every day with the series' mean residual and population deviation."""
    table = scored.select(SERIES, DATE, actual, prediction, (F.col(actual) - F.col(prediction)).alias("residual"))
    return with_group_stats(table, [SERIES], {"mean_error": F.avg("residual"), "std_error": F.stddev_pop("residual")})


def residual_histogram(scored: DataFrame, bins: int = 50, actual: str = TARGET, prediction: str = "prediction") -> DataFrame:
    table = scored.select(SERIES, (F.col(actual) - F.col(prediction)).alias("residual"))
    return histogram(table, "residual", bins)


# Upper ends and labels of the error classes.
ERROR_CLASSES = ((5, "0-5%"), (10, "5-10%"), (15, "10-15%"), (20, "15-20%"))


def error_buckets(scored: DataFrame, actual: str = TARGET, prediction: str = "prediction") -> DataFrame:
    """Days per absolute percentage error class; zero actuals have no percentage and are left out."""
    pct = F.abs(F.try_divide(F.col(actual) - F.col(prediction), F.col(actual))) * 100
    label = F.when(F.col("_pct").isNull(), None)
    for upper, name in ERROR_CLASSES:
        label = label.when(F.col("_pct") <= upper, name)
    labelled = scored.withColumn("_pct", pct).withColumn("bucket", label.otherwise(">20%"))
    return labelled.where(F.col("bucket").isNotNull()).groupBy(SERIES, "bucket").agg(F.count("*").alias("n_days"))


def forecast_view(daily: DataFrame, forecast: DataFrame, history_rows: int = 60, target: str = TARGET) -> DataFrame:
    """The last `history_rows` days followed by the forecast and its interval."""
    back = F.row_number().over(Window.partitionBy(SERIES).orderBy(F.desc(DATE)))
    recent = daily.withColumn("_back", back).where(F.col("_back") <= history_rows)
    past = recent.select(SERIES, DATE, F.lit("history").alias("part"), F.col(target).alias("value"))
    ahead = forecast.select(
        SERIES, DATE, F.lit("forecast").alias("part"), F.col("prediction").alias("value"), "ci_lower", "ci_upper"
    )
    return past.unionByName(ahead, allowMissingColumns=True)


def compare_methods(first: DataFrame, second: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Metric by metric, two methods side by side."""
    metrics = ["mae", "rmse", "mape", "r2"]

    def long(table: DataFrame, name: str) -> DataFrame:
        present = [m for m in metrics if m in table.columns]
        return table.unpivot(SERIES, present, "metric", name)

    return long(first, names[0]).join(long(second, names[1]), [SERIES, "metric"], "full")
