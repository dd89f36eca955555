"""Engine tables from the given tables: minute readings, hourly-like rows, daily fleets, profiles.

Prices and values are scaled by long factors so that rounded means have no exact ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.config import DATE, HOUR_TS, SERIES, TS, AnomalyConfig
from hourloom.functions.calendar import day_metadata, truncate
from hourloom.operators import anomaly, features, resample
from hourloom.plans import training
from hourloom.session import materialize

LOOSE = AnomalyConfig(iqr_threshold=0.75, zscore_threshold=1.5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known minutes per event type."""
    v = F.col("value")
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias(SERIES), truncate("minute", F.col("ts")).alias(TS))
        .agg(
            (F.avg(v) * 0.0103141592653).alias("Global_active_power"),
            (F.min(v) * 0.00103141592653).alias("Global_reactive_power"),
            (F.max(v) * 0.0103141592653 + 230).alias("Voltage"),
            (F.sum(v) * 0.0434897932384).alias("Global_intensity"),
            (F.sum(F.when(v < 20, v)) * 0.0103141592653).alias("Sub_metering_1"),
            (F.sum(F.when((v >= 20) & (v < 60), v)) * 0.0103141592653).alias("Sub_metering_2"),
            (F.sum(F.when(v >= 60, v)) * 0.0103141592653).alias("Sub_metering_3"),
        )
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense minutes; quiet minutes are null."""
    minutes = event_minutes(spark, sf_dir)
    span = minutes.groupBy(SERIES).agg(F.min(TS).alias("lo"), F.max(TS).alias("hi"))
    spine = span.select(SERIES, F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MINUTE"))).alias(TS))
    return spine.join(minutes, [SERIES, TS], "left")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.with_hour_calendar(resample.hourly_rollup(event_minutes(spark, sf_dir)))


def filled_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of the gap-filled readings, written once for its several readers."""
    return cached("filled_hourly", lambda s, d: training.prepare(readings(s, d))[0], spark, sf_dir)


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the layout of the hourly table: one series per priority."""
    price, status = F.col("o_totalprice") * 0.00100314159265, F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias(SERIES),
        F.col("o_orderdate").alias(HOUR_TS),
        price.alias("Global_active_power"),
        (F.col("o_totalprice") * 0.000100314159265).alias("Global_reactive_power"),
        (F.col("o_custkey") * 0.000991593628 + 230).alias("Voltage"),
        (F.col("o_totalprice") * 0.00436781659214).alias("Global_intensity"),
        F.when(status == "F", price).alias("Sub_metering_1"),
        F.when(status == "O", price).alias("Sub_metering_2"),
        F.when(status == "P", price).alias("Sub_metering_3"),
    )


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long daily history, one series per order priority."""
    return resample.daily_summary(order_rows(spark, sf_dir))


def line_rows(spark: SparkSession, sf_dir: str, series: Column) -> DataFrame:
    """Line items in the layout of the hourly table."""
    price, flag = F.col("l_extendedprice") * 0.00100314159265, F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        series.alias(SERIES),
        F.col("l_shipdate").alias(HOUR_TS),
        price.alias("Global_active_power"),
        (price * F.col("l_discount")).alias("Global_reactive_power"),
        (F.col("l_quantity") * 0.14285314159265 + 230).alias("Voltage"),
        (F.col("l_extendedprice") * 0.00436781659214).alias("Global_intensity"),
        F.when(flag == "R", price).alias("Sub_metering_1"),
        F.when(flag == "A", price).alias("Sub_metering_2"),
        F.when(flag == "N", price).alias("Sub_metering_3"),
    )


def written_order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order days as a table that models and forecasts of one session share."""
    return cached("order_days", lambda s, d: materialize(order_days(s, d), "order_days"), spark, sf_dir)


def fleet_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many daily series: one per supplier."""
    return resample.daily_summary(line_rows(spark, sf_dir, F.col("l_suppkey").cast("string")))


def weekly_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete 7-slot weeks per return flag and line status, dated by their Monday."""
    at = F.col(HOUR_TS)
    cells = line_rows(spark, sf_dir, F.concat("l_returnflag", "l_linestatus")).select(
        SERIES,
        truncate("week", at).cast("date").alias(DATE),
        F.weekday(at).alias("slot"),
        "Global_active_power",
    )
    weeks = resample.slot_profiles(cells, "slot", "Global_active_power", 7)
    return weeks.withColumns(day_metadata(F.col(DATE)))


def half_month_cluster() -> Column:
    """Stand-in label that SQL can compute: season and half of the month."""
    return (F.col("season") * 2 + (F.dayofmonth(DATE) > 15).cast("int")).cast("int")


def clustered_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks with their stand-in label, written once for readers that need them several times."""
    return materialize(weekly_profiles(spark, sf_dir).withColumn("cluster", half_month_cluster()), "weeks")


def labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled vectors as profiles of one series."""
    return table(spark, sf_dir, "embeddings").select(
        F.lit("all").alias(SERIES),
        F.date_add(F.lit("2000-01-01").cast("date"), F.col("vec_id").cast("int")).alias(DATE),
        F.col("embedding").cast("array<double>").alias("profile"),
        "label",
    )


def order_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in day labels for the order series; Sundays have no label."""
    days = written_order_days(spark, sf_dir)
    label = (F.col("season") * 2 + F.col("is_weekend")).cast("int")
    return days.where(F.col("day_of_week") < 6).select(SERIES, DATE, label.alias("cluster"))


def flagged_fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fleet days with the two statistical voters (loose thresholds) and their vote."""
    flagged = anomaly.both_statistical_flags(fleet_days(spark, sf_dir), LOOSE)
    return anomaly.vote(flagged, ("anomaly_iqr", "anomaly_zscore"), 2)


def lag_week_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in predictions that SQL can compute: the value seven rows earlier."""
    days = order_days(spark, sf_dir).withColumns(features.lag_columns())
    return days.select(SERIES, DATE, "total_daily_consumption", F.col("lag_7d").alias("prediction")).where(
        F.col("prediction").isNotNull()
    )


_SHARED: dict = {}


def cached(key: str, builder, spark: SparkSession, sf_dir: str):
    """Written tables and fitted models that the queries of one application share."""
    place = (key, spark.sparkContext.applicationId, sf_dir)
    if place not in _SHARED:
        _SHARED[place] = builder(spark, sf_dir)
    return _SHARED[place]


def forget() -> None:
    """Drop what the queries of this process share, so that the next one builds it again."""
    _SHARED.clear()
