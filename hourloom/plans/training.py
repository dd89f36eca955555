"""The whole run as one chain of lazy tables, with a written table wherever several steps read one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.config import DATE, MEASURES, SERIES, TARGET, TS, RunConfig
from hourloom.operators import anomaly, clean, cluster, features, forecast, model, resample
from hourloom.session import materialize


def prepare(
    readings: DataFrame, config: RunConfig = RunConfig(), method: str = "interpolate"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hourly table, daily table and day profiles of raw readings; the hourly table is written once."""
    filled = clean.handle_missing(readings.select(SERIES, TS, *MEASURES), method, limits=config.gaps)
    hourly = materialize(resample.with_hour_calendar(resample.hourly_rollup(filled)), "hourly")
    return hourly, resample.daily_summary(hourly), resample.daily_profiles(hourly)


@dataclass(frozen=True)
class TrainedRun:
    """`daily` holds every day with its vote, `clean` the kept days with their cluster (the history of forecasts)."""

    daily: DataFrame
    clean: DataFrame
    clustered: DataFrame
    features: DataFrame
    inputs: list[str]
    model: PipelineModel
    train_metrics: DataFrame
    test_metrics: DataFrame
    n_clusters: int


def fit_daily_model(
    days: DataFrame, clustered: DataFrame | None, config: RunConfig = RunConfig()
) -> tuple[DataFrame, list[str], PipelineModel, DataFrame]:
    """Feature table with its split, model inputs, fitted forest and the scored rows."""
    table = features.build_features(days, clustered, leak_free=config.leak_free)
    inputs = features.model_inputs(table.columns, config.leak_free)
    usable = model.time_split(clean.drop_unusable(table, TARGET, inputs), config.test_size)
    usable = materialize(usable, "features")
    train_rows = usable.where(F.col("split") == "train")
    fitted = model.train(train_rows, inputs, model.forest(config=config.forest), partitions=config.forest.partitions)
    return usable, inputs, fitted, model.predict(fitted, usable, inputs)


def train_run(daily: DataFrame, profiles: DataFrame, config: RunConfig = RunConfig()) -> TrainedRun:
    """Anomaly vote, clean days, clusters, features, forest and its metrics."""
    flagged = materialize(anomaly.detect_anomalies(daily, profiles, config.anomaly), "flagged")
    kept = anomaly.clean_days(flagged)
    clusters = cluster.fit_profile_clusters(profiles, config.clusters, config.kmeans)
    clustered = clusters.assign(profiles)
    table, inputs, fitted, scored = fit_daily_model(kept, clustered, config)
    by_split = model.regression_metrics(scored, keys=(SERIES, "split"))
    return TrainedRun(
        flagged,
        features.join_clusters(kept, clustered),
        clustered,
        table,
        inputs,
        fitted,
        by_split.where(F.col("split") == "train").drop("split"),
        by_split.where(F.col("split") == "test").drop("split"),
        len(clusters.labels),
    )


def run_report(run: TrainedRun) -> DataFrame:
    """Per series: date range, days, clean days, removed days, profiles and metrics of both splits."""
    days = run.daily.groupBy(SERIES).agg(
        F.min(DATE).alias("first_date"),
        F.max(DATE).alias("last_date"),
        F.count("*").alias("total_days"),
        F.count_if(~F.col("is_anomaly")).alias("clean_days"),
        F.count_if("is_anomaly").alias("anomalies_removed"),
    )
    profiles = run.clustered.groupBy(SERIES).agg(F.count("*").alias("clustered_profiles"))

    def prefixed(metrics: DataFrame, prefix: str) -> DataFrame:
        return metrics.select(SERIES, *[F.col(m).alias(f"{prefix}_{m}") for m in ("mae", "rmse", "r2", "mape")])

    report = days.join(profiles, SERIES, "left").withColumn("n_clusters", F.lit(run.n_clusters))
    report = report.join(prefixed(run.train_metrics, "train"), SERIES, "left")
    return report.join(prefixed(run.test_metrics, "test"), SERIES, "left")


def holdout_sigma(scored_test: DataFrame) -> DataFrame:
    """Spread of a one-day forecast per series: the RMSE of the test rows."""
    return model.regression_metrics(scored_test).select(SERIES, F.col("rmse").alias("sigma"))


def states_for(clean_days: DataFrame, daily: DataFrame, sigma: DataFrame | None = None) -> DataFrame:
    return forecast.forecast_states(clean_days, daily, sigma)
