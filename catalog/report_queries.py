"""The tables behind the plots."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog import ctes, inputs
from catalog.forecast_queries import ready
from catalog.model_queries import METRICS_SQL, fitted
from catalog.registry import query, sql_with
from hourloom.config import DATE, SERIES, TARGET
from hourloom.operators import anomaly, features, forecast, model, report

STATISTICAL = ("anomaly_iqr", "anomaly_zscore")
HOURS = (ctes.MINUTES, ctes.hourly("minutes"))


@query(
    "daily_trend",
    "V1",
    sql_with(
        ctes.FLAGGED_FLEET,
        """rolled AS (SELECT *, count(total_daily_consumption) OVER w AS n, avg(total_daily_consumption) OVER w AS m FROM flagged_fleet
        WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))""",
        select="""SELECT series_id, CAST(date AS VARCHAR) AS date, round(total_daily_consumption, 6) AS total_daily_consumption, is_anomaly,
        CASE WHEN n = 30 THEN round(m, 6) END AS rolling_mean FROM rolled""",
    ),
)
def daily_trend(spark, sf_dir):
    return report.daily_trend(inputs.flagged_fleet(spark, sf_dir))


def mean_sql(keys: str) -> str:
    return sql_with(*HOURS, select=f"SELECT series_id, {keys}, round(avg(Global_active_power), 6) AS mean FROM hourly GROUP BY ALL")


@query("mean_by_hour", "V2", mean_sql("hour"))
def mean_by_hour(spark, sf_dir):
    return report.mean_by_hour(inputs.hourly(spark, sf_dir))


@query("mean_by_hour_and_weekend", "V3", mean_sql("is_weekend, hour"))
def mean_by_hour_and_weekend(spark, sf_dir):
    return report.mean_by_hour_and_weekend(inputs.hourly(spark, sf_dir))


@query("mean_by_weekday", "V4", mean_sql("day_of_week"))
def mean_by_weekday(spark, sf_dir):
    return report.mean_by_weekday(inputs.hourly(spark, sf_dir))


@query("mean_by_month", "V5", mean_sql("month"))
def mean_by_month(spark, sf_dir):
    return report.mean_by_month(inputs.hourly(spark, sf_dir))


@query(
    "usage_patterns",
    "V2 V3 V4 V5",
    sql_with(
        *HOURS,
        """grouped AS (SELECT series_id, hour, is_weekend, day_of_week, month, avg(Global_active_power) AS mean FROM hourly
        GROUP BY GROUPING SETS ((series_id, hour), (series_id, is_weekend, hour), (series_id, day_of_week), (series_id, month)))""",
        select="""SELECT CASE WHEN day_of_week IS NOT NULL THEN 'weekday' WHEN month IS NOT NULL THEN 'month'
        WHEN is_weekend IS NOT NULL THEN 'hour_by_weekend' ELSE 'hour' END AS view, series_id, hour, is_weekend, day_of_week, month,
        round(mean, 6) AS mean FROM grouped""",
    ),
)
def usage_patterns(spark, sf_dir):
    return report.usage_patterns(inputs.hourly(spark, sf_dir))


@query(
    "cluster_curves",
    "V6",
    sql_with(
        ctes.WEEKS,
        select="SELECT cluster, slot AS hour, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, count(*) AS n_days FROM weeks GROUP BY 1, 2",
    ),
)
def cluster_curves(spark, sf_dir):
    return report.cluster_curves(inputs.clustered_weeks(spark, sf_dir))


@query("sample_profiles", "V7")
def sample_profiles(spark, sf_dir):
    sampled = report.sample_profiles(inputs.clustered_weeks(spark, sf_dir))
    return sampled.select(SERIES, DATE, "cluster", F.posexplode("profile").alias("hour", "v"))


@query(
    "actual_vs_predicted",
    "V8",
    sql_with(
        ctes.LAG_WEEK,
        f"metrics AS ({METRICS_SQL})",
        """ends AS (SELECT series_id, round(least(min(total_daily_consumption), min(prediction)), 6) AS line_from,
        round(greatest(max(total_daily_consumption), max(prediction)), 6) AS line_to FROM scored GROUP BY 1)""",
        select="SELECT * FROM metrics JOIN ends USING (series_id)",
    ),
)
def actual_vs_predicted(spark, sf_dir):
    return report.actual_vs_predicted(inputs.lag_week_scores(spark, sf_dir))


def histogram_sql(keys: str, value: str, bins: str) -> tuple[str, str]:
    stats = f"""sized AS (SELECT *, min({value}) OVER g AS lo, max({value}) OVER g AS hi, count(*) OVER g AS n, {bins} AS bins
        FROM valued WINDOW g AS (PARTITION BY {keys})),
    binned AS (SELECT *, (hi - lo) / bins AS width,
        CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor(({value} - lo) / ((hi - lo) / bins)), bins - 1) END AS INTEGER) AS bin FROM sized)"""
    select = f"""SELECT {keys}, bin, round(any_value(lo) + bin * any_value(width), 6) AS bin_from, count(*) AS count,
        CASE WHEN any_value(width) > 0 THEN round(count(*) / (any_value(n) * any_value(width)), 6) END AS density FROM binned GROUP BY {keys}, bin"""
    return stats, select


HIST = histogram_sql("series_id, is_anomaly", "total_daily_consumption", "CASE WHEN is_anomaly THEN 20 ELSE 50 END")


@query(
    "consumption_histogram",
    "V10",
    sql_with(ctes.FLAGGED_FLEET, "valued AS (SELECT * FROM flagged_fleet)", HIST[0], select=HIST[1]),
)
def consumption_histogram(spark, sf_dir):
    return report.consumption_histogram(inputs.flagged_fleet(spark, sf_dir))


@query(
    "detections_by_method",
    "V11",
    sql_with(
        ctes.ORDER_DAYS,
        ctes.flags("order_days", "flagged", 0.75, 1.5),
        select="""SELECT series_id, 'iqr' AS method, count(*) FILTER (anomaly_iqr) AS n_days FROM flagged GROUP BY 1
        UNION ALL SELECT series_id, 'zscore', count(*) FILTER (anomaly_zscore) FROM flagged GROUP BY 1""",
    ),
)
def detections_by_method(spark, sf_dir):
    flagged = anomaly.both_statistical_flags(inputs.order_days(spark, sf_dir), inputs.LOOSE)
    return report.detections_by_method(flagged, STATISTICAL)


@query(
    "vote_distribution",
    "V12",
    sql_with(ctes.FLAGGED_FLEET, select="SELECT series_id, anomaly_count, count(*) AS n_days FROM flagged_fleet GROUP BY 1, 2"),
)
def vote_distribution(spark, sf_dir):
    return report.vote_distribution(inputs.flagged_fleet(spark, sf_dir))


@query(
    "residuals",
    "V13",
    sql_with(
        ctes.LAG_WEEK,
        "valued AS (SELECT *, total_daily_consumption - prediction AS residual FROM scored)",
        select="""SELECT series_id, CAST(date AS VARCHAR) AS date, round(total_daily_consumption, 6) AS total_daily_consumption,
        round(prediction, 6) AS prediction, round(residual, 6) AS residual,
        round(avg(residual) OVER (PARTITION BY series_id), 6) AS mean_error,
        round(stddev_pop(residual) OVER (PARTITION BY series_id), 6) AS std_error FROM valued""",
    ),
)
def residuals(spark, sf_dir):
    return report.residuals(inputs.lag_week_scores(spark, sf_dir))


RESIDUAL_HIST = histogram_sql("series_id", "residual", "50")


@query(
    "residual_histogram",
    "V14",
    sql_with(
        ctes.LAG_WEEK,
        "valued AS (SELECT series_id, total_daily_consumption - prediction AS residual FROM scored)",
        RESIDUAL_HIST[0],
        select=RESIDUAL_HIST[1],
    ),
)
def residual_histogram(spark, sf_dir):
    return report.residual_histogram(inputs.lag_week_scores(spark, sf_dir))


@query(
    "error_buckets",
    "V15",
    sql_with(
        ctes.LAG_WEEK,
        "valued AS (SELECT series_id, abs((total_daily_consumption - prediction) / nullif(total_daily_consumption, 0)) * 100 AS pct FROM scored)",
        select="""SELECT series_id, CASE WHEN pct <= 5 THEN '0-5%' WHEN pct <= 10 THEN '5-10%' WHEN pct <= 15 THEN '10-15%'
        WHEN pct <= 20 THEN '15-20%' ELSE '>20%' END AS bucket, count(*) AS n_days FROM valued WHERE pct IS NOT NULL GROUP BY 1, 2""",
    ),
)
def error_buckets(spark, sf_dir):
    return report.error_buckets(inputs.lag_week_scores(spark, sf_dir))


@query(
    "forecast_view",
    "V16",
    sql_with(
        ctes.LAG_WEEK,
        "backwards AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS r FROM order_days)",
        "last7 AS (SELECT * FROM backwards WHERE r <= 7)",
        """placed AS (SELECT series_id, date + 7 AS day, total_daily_consumption AS prediction,
        CAST(date + 7 - max(date) OVER (PARTITION BY series_id) AS INTEGER) AS h FROM last7)""",
        "ahead AS (SELECT series_id, day AS date, prediction, 2.626 * sqrt(h) AS spread FROM placed WHERE h >= 0)",
        select="""SELECT series_id, CAST(date AS VARCHAR) AS date, 'history' AS part, round(total_daily_consumption, 6) AS value,
        CAST(NULL AS DOUBLE) AS ci_lower, CAST(NULL AS DOUBLE) AS ci_upper FROM backwards WHERE r <= 60
        UNION ALL SELECT series_id, CAST(date AS VARCHAR), 'forecast', round(prediction, 6), round(greatest(0, prediction - 1.96 * spread), 6),
        round(prediction + 1.96 * spread, 6) FROM ahead""",
    ),
)
def forecast_view(spark, sf_dir):
    """History and a stand-in forecast that repeats the last seven rows a week later."""
    days = inputs.order_days(spark, sf_dir)
    back = F.row_number().over(Window.partitionBy(SERIES).orderBy(F.desc(DATE)))
    last_date = F.max(DATE).over(Window.partitionBy(SERIES))
    week = days.select(SERIES, DATE, TARGET, back.alias("r"), last_date.alias("last_date")).where(F.col("r") <= 7)
    ahead = week.select(
        SERIES,
        F.date_add(DATE, 7).alias(DATE),
        F.col(TARGET).alias("prediction"),
        F.datediff(F.date_add(DATE, 7), "last_date").alias("days_ahead"),
    ).where(F.col("days_ahead") >= 0)
    return report.forecast_view(days, forecast.with_interval(ahead))


@query("recursive_forecast_view", "V16")
def recursive_forecast_view(spark, sf_dir):
    at = ready(spark, sf_dir)
    ahead = forecast.forecast_ahead(at.states, at.forest, fitted(spark, sf_dir).inputs, 30)
    return report.forecast_view(inputs.order_days(spark, sf_dir), ahead)


@query(
    "compare_methods",
    "V17",
    sql_with(
        ctes.ORDER_DAYS,
        """lagged AS (SELECT series_id, total_daily_consumption AS y, lag(total_daily_consumption, 1) OVER w AS one,
        lag(total_daily_consumption, 7) OVER w AS seven FROM order_days WINDOW w AS (PARTITION BY series_id ORDER BY date)),
        errors AS (SELECT series_id, y, y - one AS e1, y - seven AS e7 FROM lagged)""",
        select=" UNION ALL ".join(
            f"SELECT series_id, '{m}' AS metric, round({f.format(e='e1')}, 6) AS yesterday, round({f.format(e='e7')}, 6) AS last_week FROM errors GROUP BY 1"
            for m, f in {
                "mae": "avg(abs({e}))",
                "rmse": "sqrt(avg({e} * {e}))",
                "mape": "avg(abs({e} / nullif(y, 0))) * 100",
                "r2": "1 - sum({e} * {e}) / (var_pop(y) FILTER ({e} IS NOT NULL) * count({e}))",
            }.items()
        ),
    ),
)
def compare_methods(spark, sf_dir):
    days = inputs.order_days(spark, sf_dir).withColumns(features.lag_columns())
    one = model.regression_metrics(days, prediction="lag_1d")
    seven = model.regression_metrics(days, prediction="lag_7d")
    return report.compare_methods(one, seven, ("yesterday", "last_week"))
