"""Features, training, evaluation, scoring."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import ctes, inputs
from catalog.data_queries import ORDER_LABELS
from catalog.registry import cols, query, sql_with
from hourloom.config import DATE, SERIES, TARGET, BoostingConfig, ForestConfig
from hourloom.operators import features, model
from hourloom.plans import training
from hourloom.session import work_path
from hourloom.sources import tables

Y = "total_daily_consumption"
W = "PARTITION BY series_id ORDER BY date"
TWO_PI = "2 * pi()"

CALENDAR_SQL = f"""
    CAST(day(date) AS INTEGER) AS day_of_month, CAST(quarter(date) AS INTEGER) AS quarter,
    CAST(week(date) AS INTEGER) AS week_of_year, CASE WHEN day(date) = 1 THEN 1 ELSE 0 END AS is_month_start,
    CASE WHEN last_day(date) = date THEN 1 ELSE 0 END AS is_month_end,
    sin({TWO_PI} * day_of_week / 7) AS day_of_week_sin, cos({TWO_PI} * day_of_week / 7) AS day_of_week_cos,
    sin({TWO_PI} * month / 12) AS month_sin, cos({TWO_PI} * month / 12) AS month_cos"""
LAGS_SQL = ", ".join(f"lag({Y}, {k}) OVER ({W}) AS lag_{k}d" for k in (1, 2, 3, 7, 14)) + f", lag({Y}, 7) OVER ({W}) AS same_day_last_week"


def rolling(fn: str, rows: int, column: str = Y) -> str:
    return f"{fn}({column}) OVER ({W} ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING)"


ROLLING_SQL = ", ".join(
    [
        f"{rolling('avg', 7)} AS last_week_avg",
        f"{rolling('avg', 14)} AS last_2weeks_avg",
        f"{rolling('avg', 7)} AS rolling_7d_mean",
        f"{rolling('stddev_samp', 7)} AS rolling_7d_std",
        f"{rolling('min', 7)} AS rolling_7d_min",
        f"{rolling('max', 7)} AS rolling_7d_max",
        f"{rolling('avg', 30)} AS rolling_30d_mean",
        f"{rolling('stddev_samp', 30)} AS rolling_30d_std",
    ]
)
TREND_SQL = f"""CAST(date - min(date) OVER (PARTITION BY series_id) AS INTEGER) AS day_number,
    lag({Y}, 1) OVER ({W}) - lag({Y}, 8) OVER ({W}) AS trend_7d"""
RATIO_SQL = f"lag({Y}, 1) OVER ({W}) / ({rolling('avg', 7)} + 1e-6) AS ratio_to_weekly_avg"
EXPANDING = f"avg({Y}) OVER (PARTITION BY series_id, {{}} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
LEAKY = f"avg({Y}) OVER (PARTITION BY series_id, {{}})"
VOLTAGE_SQL = f"Voltage_mean AS voltage_avg, {rolling('avg', 7, 'Voltage_mean')} AS voltage_7d_avg"

CALENDAR_OUT = "day_of_month quarter week_of_year is_month_start is_month_end day_of_week_sin:r day_of_week_cos:r month_sin:r month_cos:r"
LAGS_OUT = "lag_1d:r lag_2d:r lag_3d:r lag_7d:r lag_14d:r same_day_last_week:r"
ROLLING_OUT = (
    "last_week_avg:r last_2weeks_avg:r rolling_7d_mean:r rolling_7d_std:r rolling_7d_min:r rolling_7d_max:r "
    "rolling_30d_mean:r rolling_30d_std:r"
)
KEY = "series_id date:s"


def names(spec: str) -> list[str]:
    return [w.partition(":")[0] for w in spec.split()]


def feature_sql(source: str, expressions: str, out: str, *before: str) -> str:
    return sql_with(*before, f"made AS (SELECT *, {expressions} FROM {source})", select=f"SELECT {cols(KEY + ' ' + out)} FROM made")


@query(
    "calendar_features",
    "F1",
    feature_sql("order_days", CALENDAR_SQL, "day_of_week month season is_weekend " + CALENDAR_OUT, ctes.ORDER_DAYS),
)
def calendar_features(spark, sf_dir):
    made = features.calendar_features(inputs.order_days(spark, sf_dir))
    return made.select(SERIES, DATE, "day_of_week", "month", "season", "is_weekend", *names(CALENDAR_OUT))


@query(
    "cyclic_features",
    "F2",
    feature_sql("fleet_days", CALENDAR_SQL, "day_of_week_sin:r day_of_week_cos:r month_sin:r month_cos:r", ctes.FLEET_DAYS),
)
def cyclic_features(spark, sf_dir):
    made = features.calendar_features(inputs.fleet_days(spark, sf_dir))
    return made.select(SERIES, DATE, "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos")


@query("lag_features", "F3", feature_sql("fleet_days", LAGS_SQL, LAGS_OUT, ctes.FLEET_DAYS))
def lag_features(spark, sf_dir):
    return inputs.fleet_days(spark, sf_dir).withColumns(features.lag_columns()).select(SERIES, DATE, *names(LAGS_OUT))


@query("rolling_features", "F4", feature_sql("fleet_days", ROLLING_SQL, ROLLING_OUT, ctes.FLEET_DAYS))
def rolling_features(spark, sf_dir):
    return inputs.fleet_days(spark, sf_dir).withColumns(features.rolling_columns()).select(SERIES, DATE, *names(ROLLING_OUT))


@query("trend_features", "F5", feature_sql("fleet_days", TREND_SQL, "day_number trend_7d:r", ctes.FLEET_DAYS))
def trend_features(spark, sf_dir):
    return inputs.fleet_days(spark, sf_dir).withColumns(features.trend_columns()).select(SERIES, DATE, "day_number", "trend_7d")


@query("ratio_features", "F6", feature_sql("fleet_days", RATIO_SQL, "ratio_to_weekly_avg:r", ctes.FLEET_DAYS))
def ratio_features(spark, sf_dir):
    return inputs.fleet_days(spark, sf_dir).withColumns(features.ratio_columns()).select(SERIES, DATE, "ratio_to_weekly_avg")


DOW = "dow_typical_consumption"


@query("weekday_mean", "F7", feature_sql("order_days", f"{EXPANDING.format('day_of_week')} AS {DOW}", f"{DOW}:r", ctes.ORDER_DAYS))
def weekday_mean(spark, sf_dir):
    return features.weekday_mean(inputs.order_days(spark, sf_dir)).select(SERIES, DATE, DOW)


@query("weekday_mean_all_days", "F7", feature_sql("order_days", f"{LEAKY.format('day_of_week')} AS {DOW}", f"{DOW}:r", ctes.ORDER_DAYS))
def weekday_mean_all_days(spark, sf_dir):
    return features.weekday_mean(inputs.order_days(spark, sf_dir), leak_free=False).select(SERIES, DATE, DOW)


@query(
    "join_clusters",
    "F8",
    sql_with(ctes.ORDER_DAYS, ORDER_LABELS, select=f"SELECT {cols(KEY + ' cluster total_daily_consumption:r')} FROM order_labelled"),
)
def join_clusters(spark, sf_dir):
    return _order_labelled(spark, sf_dir).select(SERIES, DATE, "cluster", TARGET)


def _order_labelled(spark, sf_dir) -> DataFrame:
    return features.join_clusters(inputs.order_days(spark, sf_dir), inputs.order_clusters(spark, sf_dir))


@query(
    "cluster_mean",
    "F9",
    feature_sql(
        "order_labelled",
        f"{LEAKY.format('cluster')} AS cluster_avg_consumption, {EXPANDING.format('cluster')} AS earlier_cluster_avg",
        "cluster cluster_avg_consumption:r earlier_cluster_avg:r",
        ctes.ORDER_DAYS,
        ORDER_LABELS,
    ),
)
def cluster_mean(spark, sf_dir):
    days = features.cluster_mean(_order_labelled(spark, sf_dir), leak_free=True)
    days = days.withColumnRenamed("cluster_avg_consumption", "earlier_cluster_avg")
    return features.cluster_mean(days, leak_free=False).select(
        SERIES, DATE, "cluster", "cluster_avg_consumption", "earlier_cluster_avg"
    )


YESTERDAY = f"coalesce(lag(cluster, 1) OVER ({W}), cluster) AS yesterday_cluster"


@query(
    "yesterday_cluster",
    "F10",
    feature_sql("order_labelled", YESTERDAY, "cluster yesterday_cluster", ctes.ORDER_DAYS, ORDER_LABELS),
)
def yesterday_cluster(spark, sf_dir):
    return features.yesterday_cluster(_order_labelled(spark, sf_dir)).select(SERIES, DATE, "cluster", "yesterday_cluster")


@query("auxiliary_features", "F11", feature_sql("fleet_days", VOLTAGE_SQL, "voltage_avg:r voltage_7d_avg:r", ctes.FLEET_DAYS))
def auxiliary_features(spark, sf_dir):
    days = inputs.fleet_days(spark, sf_dir).withColumns(features.auxiliary_columns())
    return days.select(SERIES, DATE, "voltage_avg", "voltage_7d_avg")


ALL_SQL = ", ".join(
    [
        CALENDAR_SQL,
        LAGS_SQL,
        ROLLING_SQL,
        TREND_SQL,
        RATIO_SQL,
        VOLTAGE_SQL,
        YESTERDAY,
        f"{EXPANDING.format('day_of_week')} AS {DOW}",
        f"{EXPANDING.format('cluster')} AS cluster_avg_consumption",
    ]
)
ALL_OUT = " ".join(
    [
        ctes.DAILY_COLUMNS.replace(KEY, ""),
        CALENDAR_OUT,
        LAGS_OUT,
        ROLLING_OUT,
        f"day_number trend_7d:r ratio_to_weekly_avg:r voltage_avg:r voltage_7d_avg:r cluster yesterday_cluster {DOW}:r "
        "cluster_avg_consumption:r",
    ]
)


@query("feature_table", "F12", feature_sql("order_labelled", ALL_SQL, ALL_OUT, ctes.ORDER_DAYS, ORDER_LABELS))
def feature_table(spark, sf_dir):
    return features.build_features(inputs.order_days(spark, sf_dir), inputs.order_clusters(spark, sf_dir))


STUDIED_SQL = ", ".join(
    [
        CALENDAR_SQL,
        LAGS_SQL,
        ROLLING_SQL,
        TREND_SQL,
        RATIO_SQL,
        VOLTAGE_SQL,
        YESTERDAY,
        f"{LEAKY.format('day_of_week')} AS {DOW}",
        f"{LEAKY.format('cluster')} AS cluster_avg_consumption",
    ]
)


@query("studied_feature_table", "F12 F7 F9", feature_sql("order_labelled", STUDIED_SQL, ALL_OUT, ctes.ORDER_DAYS, ORDER_LABELS))
def studied_feature_table(spark, sf_dir):
    """Group means over all days, as the studied code takes them."""
    return features.build_features(inputs.order_days(spark, sf_dir), inputs.order_clusters(spark, sf_dir), leak_free=False)


STUDIED_OUT = " ".join(w for w in ALL_OUT.split() if w.partition(":")[0] in features.model_inputs(names(ALL_OUT), False))


@query("studied_model_inputs", "M1", feature_sql("order_labelled", STUDIED_SQL, STUDIED_OUT, ctes.ORDER_DAYS, ORDER_LABELS))
def studied_model_inputs(spark, sf_dir):
    table = studied_feature_table(spark, sf_dir)
    return table.select(SERIES, DATE, *features.model_inputs(table.columns, False))


# ---------------------------------------------------------------- split and folds

MODEL_OUT = " ".join(w for w in ALL_OUT.split() if w.partition(":")[0] in features.model_inputs(names(ALL_OUT)))


@query("model_inputs", "M1", feature_sql("order_labelled", ALL_SQL, MODEL_OUT, ctes.ORDER_DAYS, ORDER_LABELS))
def model_inputs(spark, sf_dir):
    table = feature_table(spark, sf_dir)
    return table.select(SERIES, DATE, *features.model_inputs(table.columns))


@query(
    "time_split",
    "M2",
    sql_with(
        ctes.FLEET_DAYS,
        f"placed AS (SELECT series_id, date, row_number() OVER ({W}) AS i, count(*) OVER (PARTITION BY series_id) AS n FROM fleet_days)",
        select="SELECT series_id, CAST(date AS VARCHAR) AS date, CASE WHEN i <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM placed",
    ),
)
def time_split(spark, sf_dir):
    return model.time_split(inputs.fleet_days(spark, sf_dir).select(SERIES, DATE))


@query(
    "fold_bounds",
    "M8",
    sql_with(
        ctes.FLEET_DAYS,
        f"placed AS (SELECT series_id, date, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM fleet_days)",
        "folds AS (SELECT unnest(generate_series(1, 5)) AS fold)",
        select="""SELECT series_id, CAST(fold AS INTEGER) AS fold, count(*) AS test_rows, CAST(min(date) AS VARCHAR) AS test_from,
        CAST(max(date) AS VARCHAR) AS test_to, CAST(min(i) AS BIGINT) AS train_rows
        FROM placed JOIN folds ON i >= n - (6 - fold) * (n // 6) AND i < n - (5 - fold) * (n // 6) GROUP BY 1, 2""",
    ),
)
def fold_bounds(spark, sf_dir):
    return model.fold_bounds(inputs.fleet_days(spark, sf_dir).select(SERIES, DATE))


# ---------------------------------------------------------------- fitted models


@dataclass(frozen=True)
class Fitted:
    """The order series' feature table, model and scores, shared by the queries below."""

    table: DataFrame
    inputs: list[str]
    model: PipelineModel
    scored: DataFrame

    def importances(self) -> dict[str, float]:
        return dict(zip(self.inputs, map(float, self.model.stages[-1].featureImportances.toArray())))


def _fit(spark, sf_dir) -> Fitted:
    days = inputs.written_order_days(spark, sf_dir)
    return Fitted(*training.fit_daily_model(days, inputs.order_clusters(spark, sf_dir)))


def fitted(spark, sf_dir) -> Fitted:
    return inputs.cached("forest", _fit, spark, sf_dir)


SCALED = ("lag_1d", "rolling_7d_mean", "day_of_week")
SCALED_SQL = ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 6) AS {c}" for c in SCALED)


@query(
    "scaled_features",
    "M3",
    sql_with(
        ctes.ORDER_DAYS,
        f"made AS (SELECT *, {LAGS_SQL}, {ROLLING_SQL} FROM order_days)",
        select=f"SELECT series_id, CAST(date AS VARCHAR) AS date, {SCALED_SQL} FROM made WHERE lag_1d IS NOT NULL",
    ),
)
def scaled_features(spark, sf_dir):
    days = inputs.order_days(spark, sf_dir).withColumns({**features.lag_columns(), **features.rolling_columns()})
    days = days.select(SERIES, DATE, *SCALED).where(F.col("lag_1d").isNotNull())
    scaled = model.standard_scaler(SCALED).fit(days).transform(days)
    values = vector_to_array("_features")
    return scaled.select(SERIES, DATE, *[values[i].alias(c) for i, c in enumerate(SCALED)])


@query("forest_scores", "M4 M9")
def forest_scores(spark, sf_dir):
    return fitted(spark, sf_dir).scored.select(SERIES, DATE, "split", TARGET, "prediction")


@query("boosted_scores", "M5")
def boosted_scores(spark, sf_dir):
    fit = fitted(spark, sf_dir)
    train_rows = fit.table.where(F.col("split") == "train")
    boosted = model.train(train_rows, fit.inputs, model.boosting(config=BoostingConfig(rounds=10)))
    return model.predict(boosted, fit.table, fit.inputs).select(SERIES, DATE, TARGET, "prediction")


@query("feature_importance", "M6 V9")
def feature_importance(spark, sf_dir):
    fit = fitted(spark, sf_dir)
    return model.top_features(model.importance_table(fit.model, fit.inputs, spark), 15)


METRICS_SQL = """SELECT series_id, count(*) AS n, round(avg(abs(total_daily_consumption - prediction)), 6) AS mae,
    round(sqrt(avg((total_daily_consumption - prediction) ** 2)), 6) AS rmse,
    round(1 - sum((total_daily_consumption - prediction) ** 2) / (var_pop(total_daily_consumption) * count(*)), 6) AS r2,
    round(avg(abs((total_daily_consumption - prediction) / nullif(total_daily_consumption, 0))) * 100, 6) AS mape,
    count(*) FILTER (total_daily_consumption = 0) AS zero_actuals FROM scored GROUP BY 1"""


@query("regression_metrics", "M7", sql_with(ctes.LAG_WEEK, select=METRICS_SQL))
def regression_metrics(spark, sf_dir):
    return model.regression_metrics(inputs.lag_week_scores(spark, sf_dir))


@query("forest_metrics", "M7")
def forest_metrics(spark, sf_dir):
    return model.regression_metrics(fitted(spark, sf_dir).scored, keys=(SERIES, "split"))


@query("cross_validation", "M8")
def cross_validation(spark, sf_dir):
    fit = fitted(spark, sf_dir)
    return model.cross_validate(fit.table.where(F.col("split") == "train"), fit.inputs, model.forest(config=ForestConfig()))


def day_requests(spark, sf_dir) -> DataFrame:
    """One request per customer order: its priority's series on its date, and half a year later."""
    orders = inputs.table(spark, sf_dir, "orders")
    later = F.when(F.col("o_orderstatus") == "P", F.add_months("o_orderdate", 6)).otherwise(F.to_date("o_orderdate"))
    return orders.select(
        F.col("o_orderkey").alias("request_id"), F.col("o_orderpriority").alias(SERIES), later.alias(DATE)
    )


@query("score_dates", "M10")
def score_dates(spark, sf_dir):
    fit = fitted(spark, sf_dir)
    scored = model.score_dates(fit.model, fit.table, day_requests(spark, sf_dir), fit.inputs)
    return scored.select("request_id", SERIES, DATE, TARGET, "prediction", F.col("features_used.lag_1d").alias("lag_1d"))


WEIGHTS = {"day_of_week": 0.31, "lag_1d": 0.0021, "rolling_7d_mean": 0.0035, "month": 0.17, "trend_7d": 0.0013, "season": 0.41, "lag_7d": 0.0027}
WEIGHT_ROWS = " UNION ALL ".join(f"SELECT series_id, date, '{f}' AS feature, {f} * {w} AS weight FROM made" for f, w in WEIGHTS.items())


@query(
    "feature_contributions",
    "M11",
    sql_with(
        ctes.ORDER_DAYS,
        f"made AS (SELECT *, {LAGS_SQL}, {ROLLING_SQL}, {TREND_SQL} FROM order_days)",
        f"weighted AS ({WEIGHT_ROWS})",
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY series_id, date ORDER BY coalesce(abs(weight), -1) DESC, feature) AS rank FROM weighted)",
        select="SELECT series_id, CAST(date AS VARCHAR) AS date, CAST(rank AS INTEGER) AS rank, feature, round(weight, 6) AS weight FROM ranked WHERE rank <= 5",
    ),
)
def feature_contributions(spark, sf_dir):
    days = inputs.order_days(spark, sf_dir)
    days = days.withColumns({**features.lag_columns(), **features.rolling_columns(), **features.trend_columns()})
    top = days.select(SERIES, DATE, F.posexplode(model.contributions(WEIGHTS)).alias("_i", "_c"))
    return top.select(SERIES, DATE, (F.col("_i") + 1).alias("rank"), "_c.feature", "_c.weight")


@query("model_roundtrip", "S4")
def model_roundtrip(spark, sf_dir):
    fit = fitted(spark, sf_dir)
    path = work_path(spark, "model")
    tables.save_model(fit.model, fit.inputs, path)
    loaded, inputs_again = tables.load_model(spark, path)
    again = model.predict(loaded, fit.table, inputs_again).select(SERIES, DATE, F.col("prediction").alias("reloaded"))
    both = fit.scored.select(SERIES, DATE, "prediction").join(again, [SERIES, DATE])
    return both.withColumn("same", F.abs(F.col("prediction") - F.col("reloaded")) < 1e-9)


