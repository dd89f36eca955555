"""Requests, recursive and seasonal forecasts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import ctes, inputs
from catalog.data_queries import ORDER_LABELS
from catalog.model_queries import day_requests, fitted
from catalog.registry import query, sql_with
from hourloom.config import DATE, SERIES, TARGET, AnomalyConfig, RunConfig
from hourloom.operators import features, forecast, model, requests, resample, seasonal
from hourloom.plans import answers, training
from hourloom.session import work_path
from hourloom.sources import tables

FORECAST = [SERIES, DATE, "days_ahead", "prediction", "uncertainty", "ci_lower", "ci_upper", "method"]


# ---------------------------------------------------------------- recursion


@dataclass(frozen=True)
class Ready:
    states: DataFrame
    forest: forecast.ForestArrays


def _ready(spark, sf_dir) -> Ready:
    fit = fitted(spark, sf_dir)
    days = inputs.written_order_days(spark, sf_dir)
    labelled = features.join_clusters(days, inputs.order_clusters(spark, sf_dir))
    sigma = training.holdout_sigma(fit.scored.where(F.col("split") == "test"))
    states = training.materialize(training.states_for(labelled, days, sigma), "states")
    return Ready(states, forecast.forest_arrays(spark, fit.model))


def ready(spark, sf_dir) -> Ready:
    return inputs.cached("states", _ready, spark, sf_dir)


@query("recursive_forecast", "R1 R2")
def recursive_forecast(spark, sf_dir):
    at = ready(spark, sf_dir)
    return forecast.forecast_ahead(at.states, at.forest, fitted(spark, sf_dir).inputs, 30).select(FORECAST)


def ranges(spark, sf_dir) -> DataFrame:
    """Per series: days 8 to 60 after its last day."""
    last = forecast.last_dates(inputs.order_days(spark, sf_dir))
    return last.select(SERIES, F.date_add("last_date", 8).alias("start_date"), F.date_add("last_date", 60).alias("end_date"))


@query("range_forecast", "R3")
def range_forecast(spark, sf_dir):
    at = ready(spark, sf_dir)
    return forecast.forecast_ranges(at.states, at.forest, fitted(spark, sf_dir).inputs, ranges(spark, sf_dir)).select(FORECAST)


@query("answer_requests", "M12")
def answer_requests(spark, sf_dir):
    fit, at = fitted(spark, sf_dir), ready(spark, sf_dir)
    answers = forecast.answer_requests(
        day_requests(spark, sf_dir), fit.table, at.states, fit.model, at.forest, fit.inputs, fit.importances()
    )
    return answers.select(
        "request_id", "status", SERIES, DATE, "day_of_week", "prediction", "actual", "error", "ci_lower", "ci_upper", "days_ahead",
        "method", F.get("top_features", 0)["feature"].alias("top_feature"),
    )


@query("forecast_export", "S5")
def forecast_export(spark, sf_dir):
    path = work_path(spark, "export")
    tables.export_csv(recursive_forecast(spark, sf_dir), path)
    return spark.read.option("header", True).schema(recursive_forecast(spark, sf_dir).schema).csv(path)


STAND_IN = ctes.LAG_WEEK + """,
ahead AS (SELECT *, CAST(row_number() OVER (PARTITION BY series_id ORDER BY date) AS INTEGER) AS days_ahead FROM scored)"""


def scored_ahead(spark, sf_dir) -> DataFrame:
    """Stand-in forecasts: last week's values, counted as days ahead of the first one."""
    scores = inputs.lag_week_scores(spark, sf_dir)
    return scores.withColumn("days_ahead", F.row_number().over(features.by_date()))


@query(
    "forecast_interval",
    "R4",
    sql_with(
        STAND_IN,
        select="""SELECT series_id, CAST(date AS VARCHAR) AS date, days_ahead, round(prediction, 6) AS prediction,
        round(2.626 * sqrt(days_ahead), 6) AS uncertainty, round(greatest(0, prediction - 1.96 * 2.626 * sqrt(days_ahead)), 6) AS ci_lower,
        round(prediction + 1.96 * 2.626 * sqrt(days_ahead), 6) AS ci_upper FROM ahead""",
    ),
)
def forecast_interval(spark, sf_dir):
    rows = forecast.with_interval(scored_ahead(spark, sf_dir))
    return rows.select(SERIES, DATE, "days_ahead", "prediction", "uncertainty", "ci_lower", "ci_upper")


@query(
    "history_stats",
    "R5",
    sql_with(
        ctes.ORDER_DAYS,
        ORDER_LABELS,
        select="""SELECT series_id, 'weekday' AS kind, day_of_week AS key, round(avg(total_daily_consumption), 6) AS mean FROM order_labelled GROUP BY 1, 3
        UNION ALL SELECT series_id, 'cluster', cluster, round(avg(total_daily_consumption), 6) FROM order_labelled GROUP BY 1, 3
        UNION ALL SELECT series_id, 'overall', NULL, round(avg(total_daily_consumption), 6) FROM order_labelled GROUP BY 1""",
    ),
)
def history_stats(spark, sf_dir):
    return forecast.history_stats(features.join_clusters(inputs.order_days(spark, sf_dir), inputs.order_clusters(spark, sf_dir)))


@query(
    "season_cluster_rule",
    "R6",
    sql_with(
        ctes.FLEET_DAYS,
        select="""SELECT series_id, CAST(date AS VARCHAR) AS date, CASE WHEN month IN (6, 7, 8) THEN 1 WHEN is_weekend = 1 THEN 2 ELSE 0 END AS cluster
        FROM fleet_days""",
    ),
)
def season_cluster_rule(spark, sf_dir):
    rule = forecast.season_cluster_rule(F.col(DATE)).alias("cluster")
    return inputs.fleet_days(spark, sf_dir).select(SERIES, DATE, rule)


@query(
    "learned_cluster_rule",
    "R6",
    sql_with(
        ctes.ORDER_DAYS,
        ORDER_LABELS,
        """counts AS (SELECT series_id, season, is_weekend, cluster,
        row_number() OVER (PARTITION BY series_id, season, is_weekend ORDER BY count(*) DESC, cluster) AS r FROM order_labelled GROUP BY 1, 2, 3, 4)""",
        select="SELECT series_id, season, is_weekend, cluster AS expected_cluster FROM counts WHERE r = 1",
    ),
)
def learned_cluster_rule(spark, sf_dir):
    return forecast.learned_cluster_rule(
        features.join_clusters(inputs.order_days(spark, sf_dir), inputs.order_clusters(spark, sf_dir))
    )


# ---------------------------------------------------------------- seasonal model


def _seasonal(spark, sf_dir) -> DataFrame:
    return training.materialize(seasonal.fit_seasonal(inputs.order_days(spark, sf_dir)), "seasonal")


@query("seasonal_models", "R7")
def seasonal_models(spark, sf_dir):
    models = inputs.cached("seasonal", _seasonal, spark, sf_dir)
    return models.select(SERIES, "last_date", "p", "d", "q", "aic", "sigma", "intercept")


@query("seasonal_order_search", "R8")
def seasonal_order_search(spark, sf_dir):
    rows = seasonal.series_rows(inputs.order_days(spark, sf_dir))
    fits = seasonal.fit_orders(rows, seasonal.SeasonalConfig().orders())
    return fits.select(SERIES, "p", "d", "q", "aic", "sigma", "reason")


@query("seasonal_forecast", "R9")
def seasonal_forecast(spark, sf_dir):
    models = inputs.cached("seasonal", _seasonal, spark, sf_dir)
    return seasonal.seasonal_range(models, ranges(spark, sf_dir)).select(SERIES, DATE, "days_ahead", "prediction", "method")


@query("seasonal_backtest", "R11")
def seasonal_backtest(spark, sf_dir):
    return seasonal.backtest(inputs.order_days(spark, sf_dir))


@query(
    "seasonal_backtest_coverage",
    "R10",
    sql_with(
        ctes.ORDER_DAYS,
        select="SELECT series_id, CAST(count(*) - floor(count(*) * 0.8) AS BIGINT) AS scored_days FROM order_days GROUP BY 1",
    ),
)
def seasonal_backtest_coverage(spark, sf_dir):
    split = model.time_split(inputs.order_days(spark, sf_dir).select(SERIES, DATE, TARGET))
    models = seasonal.fit_seasonal(split.where(F.col("split") == "train"), auto=False)
    held = seasonal.seasonal_holdout(models, split.where(F.col("split") == "test"))
    return held.where(F.col("prediction").isNotNull()).groupBy(SERIES).agg(F.count("*").alias("scored_days"))


@query(
    "holdout_metrics",
    "M7",
    sql_with(
        ctes.LAG_WEEK,
        "placed AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) AS i, count(*) OVER (PARTITION BY series_id) AS n FROM scored)",
        select="""SELECT series_id, count(*) AS n, round(avg(abs(total_daily_consumption - prediction)), 6) AS mae,
        round(sqrt(avg((total_daily_consumption - prediction) ** 2)), 6) AS rmse,
        round(avg(abs((total_daily_consumption - prediction) / nullif(total_daily_consumption, 0))) * 100, 6) AS mape
        FROM placed WHERE i > floor(n * 0.8) GROUP BY 1""",
    ),
)
def holdout_metrics(spark, sf_dir):
    split = model.time_split(inputs.lag_week_scores(spark, sf_dir))
    actual = split.where(F.col("split") == "test").select(SERIES, DATE, TARGET)
    predicted = inputs.lag_week_scores(spark, sf_dir).select(SERIES, DATE, "prediction")
    metrics = model.regression_metrics(actual.join(predicted, [SERIES, DATE]))
    return metrics.select(SERIES, "n", "mae", "rmse", "mape")


# ---------------------------------------------------------------- requests


def text_requests(spark, sf_dir) -> DataFrame:
    """Orders as request texts: the comment depends on the price, dates come from the order."""
    p, d = F.col("o_totalprice"), F.col("o_orderdate")
    text = (
        F.when(p < 40000, "Predict tomorrow's usage")
        .when(p < 80000, "and TODAY?")
        .when(p < 120000, "what was yesterday")
        .when(p < 160000, "What about next week?")
        .when(p < 200000, "next month please")
        .when(p < 260000, F.concat(F.lit("usage on "), F.date_format(d, "yyyy-MM-dd")))
        .when(p < 320000, F.concat(F.lit("for "), F.date_format(d, "dd/MM/yyyy"), F.lit(" thanks")))
        .when(p < 360000, "on 2031-01-01")
        .when(p < 400000, "on 31/02/2010")
        .when(p < 430000, "")
        .otherwise("how much?")
    )
    return inputs.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.col("o_orderpriority").alias(SERIES), text.alias("query")
    )


ASKED_SQL = """
asked AS (SELECT o_orderkey AS request_id, o_orderpriority AS series_id, o_totalprice AS p, CAST(o_orderdate AS DATE) AS d FROM orders),
backwards AS (SELECT series_id, date, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS r FROM order_days),
ends AS (SELECT series_id, max(date) AS last_date, max(CASE WHEN r = 10 THEN date END) AS latest,
  max(CASE WHEN r = 11 THEN date END) AS before_latest FROM backwards GROUP BY 1),
dated AS (SELECT a.*, last_date, CASE WHEN p < 40000 THEN last_date + 1 WHEN p < 80000 THEN latest WHEN p < 120000 THEN before_latest
  WHEN p < 160000 THEN last_date + 7 WHEN p < 200000 THEN last_date + 30 WHEN p < 320000 THEN d WHEN p < 360000 THEN DATE '2031-01-01'
  WHEN p < 400000 THEN NULL WHEN p < 430000 THEN latest END AS date FROM asked a JOIN ends e ON e.series_id = a.series_id)"""


@query(
    "resolve_requests",
    "R12 R13",
    sql_with(
        ctes.ORDER_DAYS,
        ASKED_SQL,
        select="""SELECT request_id, series_id, CAST(date AS VARCHAR) AS date, CAST(date - last_date AS INTEGER) AS days_ahead,
        CASE WHEN date IS NULL THEN 'no_date' WHEN date - last_date > 365 THEN 'too_far' ELSE 'ok' END AS status FROM dated""",
    ),
)
def resolve_requests(spark, sf_dir):
    anchors = requests.anchor_dates(inputs.order_days(spark, sf_dir))
    return requests.resolve_requests(text_requests(spark, sf_dir), anchors).drop("query")


@query(
    "answer_questions",
    "M12 R12",
    sql_with(
        ctes.ORDER_DAYS,
        ASKED_SQL,
        select="""SELECT request_id, series_id, CAST(date AS VARCHAR) AS date, CAST(date - last_date AS INTEGER) AS days_ahead,
        CASE WHEN date IS NULL THEN 'no_date' WHEN date - last_date > 365 THEN 'too_far' ELSE 'ok' END AS status,
        coalesce(date - last_date <= 365, false) AS answered FROM dated WHERE date IS NULL OR date > last_date""",
    ),
)
def answer_questions(spark, sf_dir):
    """Every question about a day that is still to come, or that names none."""
    fit, at = fitted(spark, sf_dir), ready(spark, sf_dir)
    known = answers.Forecaster(at.states, at.forest, fit.importances())
    days = inputs.written_order_days(spark, sf_dir)
    found = answers.answer_questions(text_requests(spark, sf_dir), days, fit.table, fit.model, fit.inputs, known)
    ahead = found.where(F.col(DATE).isNull() | (F.col("days_ahead") > 0))
    return ahead.select("request_id", SERIES, DATE, "days_ahead", "status", F.col("prediction").isNotNull().alias("answered"))


@query(
    "check_ranges",
    "R13",
    """SELECT l_orderkey AS order_id, l_linenumber AS line, CAST(o_orderdate AS DATE)::VARCHAR AS start_date, CAST(l_shipdate AS DATE)::VARCHAR AS end_date,
    CAST(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) + 1 AS INTEGER) AS range_days,
    CASE WHEN CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE) THEN 'end_before_start'
      WHEN CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) + 1 > 365 THEN 'too_long' ELSE 'ok' END AS status
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def check_ranges(spark, sf_dir):
    lines = inputs.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.to_date("l_shipdate").alias("end_date")
    )
    orders = inputs.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.to_date("o_orderdate").alias("start_date")
    )
    return requests.check_ranges(lines.join(orders, "order_id"))


@query(
    "next_days",
    "R13",
    sql_with(
        ctes.FLEET_DAYS,
        "ends AS (SELECT series_id, max(date) AS last_date, count(*) AS n FROM fleet_days GROUP BY 1)",
        select="""SELECT series_id, CAST(last_date AS VARCHAR) AS last_date, CASE WHEN n BETWEEN 1 AND 365 THEN CAST(last_date + 1 AS VARCHAR) END AS start_date,
        CASE WHEN n BETWEEN 1 AND 365 THEN CAST(last_date + CAST(n AS INTEGER) AS VARCHAR) END AS end_date,
        CASE WHEN n BETWEEN 1 AND 365 THEN 'ok' ELSE 'bad_horizon' END AS status FROM ends""",
    ),
)
def next_days(spark, sf_dir):
    ends = inputs.fleet_days(spark, sf_dir).groupBy(SERIES).agg(
        F.max(DATE).alias("last_date"), F.count("*").cast("int").alias("n")
    )
    return requests.next_days(ends, F.col("n")).drop("n")


@query(
    "range_summary",
    "R14",
    sql_with(
        STAND_IN,
        select="""SELECT series_id, round(avg(prediction), 6) AS average, round(min(prediction), 6) AS minimum,
        round(max(prediction), 6) AS maximum, round(sum(prediction), 4) AS total FROM ahead GROUP BY 1""",
    ),
)
def range_summary(spark, sf_dir):
    return forecast.range_summary(scored_ahead(spark, sf_dir)).withColumn("total", F.round("total", 4))


# ---------------------------------------------------------------- the whole run


@query("run_report", "V18")
def run_report(spark, sf_dir):
    rows = inputs.line_rows(spark, sf_dir, F.concat("l_returnflag", "l_linestatus"))
    daily = resample.daily_summary(rows)
    weeks = inputs.weekly_profiles(spark, sf_dir)
    run = training.train_run(daily, weeks, RunConfig(anomaly=AnomalyConfig(profile_slots=7)))
    return training.run_report(run)
