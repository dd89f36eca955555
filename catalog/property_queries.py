"""Properties of fitted results that SQL can state: grids, ranges, key sets and round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import ctes, inputs
from catalog.detect_queries import assign_new_profiles, cluster_centers, cluster_profiles, cluster_silhouette
from catalog.detect_queries import fit_vectors, fit_weeks, isolation_anomalies, isolation_scores
from catalog.forecast_queries import answer_requests, range_forecast, recursive_forecast, run_report, seasonal_backtest, seasonal_forecast
from catalog.forecast_queries import seasonal_models, seasonal_order_search
from catalog.model_queries import boosted_scores, cross_validation, fitted, forest_scores, model_roundtrip, score_dates
from catalog.registry import query, sql_with
from catalog.report_queries import sample_profiles
from hourloom.config import DATE, SERIES, TARGET
from hourloom.operators import cluster, model
from hourloom.session import work_path
from hourloom.sources import tables

DAYS_PER_SERIES = sql_with(ctes.ORDER_DAYS, select="SELECT series_id, count(*) AS n_days, true AS holds FROM order_days GROUP BY 1")


def per_series(rows: DataFrame, holds) -> DataFrame:
    """Rows per series, and whether the condition holds for all of them."""
    return rows.groupBy(SERIES).agg(F.count("*").alias("n_days"), F.bool_and(F.coalesce(holds, F.lit(False))).alias("holds"))


@query("isolation_share", "N3", DAYS_PER_SERIES)
def isolation_share(spark, sf_dir):
    """Every day is judged, and about the contamination's share is flagged."""
    days = isolation_anomalies(spark, sf_dir)
    share = F.avg(F.col("anomaly_isolation_forest").cast("double"))
    found = days.groupBy(SERIES).agg(F.count("*").alias("n_days"), share.alias("share"))
    return found.select(SERIES, "n_days", (F.abs(F.col("share") - 0.05) < 0.03).alias("holds"))


@query("isolation_score_range", "N9", DAYS_PER_SERIES)
def isolation_score_range(spark, sf_dir):
    return per_series(isolation_scores(spark, sf_dir), F.abs("isolation_score") <= 1)


@query(
    "cluster_label_range",
    "K1",
    sql_with(ctes.WEEKS, select="SELECT series_id, count(DISTINCT date) AS n_days, true AS holds FROM weeks GROUP BY 1"),
)
def cluster_label_range(spark, sf_dir):
    return per_series(cluster_profiles(spark, sf_dir), F.col("cluster").between(0, 4))


@query("cluster_center_order", "K4", "SELECT true AS holds, 7 AS hours FROM lineitem LIMIT 1")
def cluster_center_order(spark, sf_dir):
    """Clusters are numbered by the level of their centres, each of which has a value for every slot."""
    levels = cluster_centers(spark, sf_dir).groupBy("cluster").agg(F.count("*").cast("int").alias("hours"), F.avg("value").alias("level"))
    below = levels.select(F.col("cluster") + 1, F.col("level").alias("before")).toDF("cluster", "before")
    ordered = levels.join(below, "cluster", "left")
    return ordered.agg(F.bool_and(F.coalesce("before", "level") <= F.col("level")).alias("holds"), F.max("hours").alias("hours"))


@query("assigned_label_range", "K7", "SELECT 'all' AS series_id, count(*) AS n_days, true AS holds FROM embeddings")
def assigned_label_range(spark, sf_dir):
    return per_series(assign_new_profiles(spark, sf_dir), F.col("cluster").between(0, 9))


@query(
    "cluster_center_means",
    "K4",
    sql_with(
        ctes.WEEKS,
        "profiles AS (SELECT list(v ORDER BY slot) AS p FROM weeks GROUP BY series_id, date)",
        "sizes AS (SELECT unnest(range(least(5, count(DISTINCT p)))) AS cluster FROM profiles)",
        select="SELECT CAST(cluster AS INTEGER) AS cluster, CAST(slot AS INTEGER) AS hour, true AS holds FROM sizes, (SELECT DISTINCT slot FROM weeks)",
    ),
)
def cluster_center_means(spark, sf_dir):
    """Five centres, or one per different week; every centre is the mean of the weeks that carry its number."""
    members = cluster_profiles(spark, sf_dir).join(inputs.weekly_profiles(spark, sf_dir), [SERIES, DATE])
    means = members.select("cluster", F.posexplode("profile").alias("hour", "v")).groupBy("cluster", "hour").agg(F.avg("v").alias("mean"))
    both = cluster_centers(spark, sf_dir).join(means, ["cluster", "hour"], "left")
    return both.select("cluster", "hour", (F.abs(F.col("value") - F.col("mean")) <= 1e-3 * F.abs("mean")).alias("holds"))


def nearest_labels(labelled: DataFrame, fit: cluster.ProfileClusters) -> DataFrame:
    """Per series, whether the centre of every row's number is the nearest of all, measured slot by slot in deviations."""
    slots = [(c, h, v, fit.factor[h]) for c, center in enumerate(fit.centers) for h, v in enumerate(center)]
    centers = labelled.sparkSession.createDataFrame(slots, "other int, hour int, value double, factor double")
    cells = labelled.select(SERIES, DATE, "cluster", F.posexplode("profile").alias("hour", "v"))
    apart = cells.join(centers, "hour").groupBy(SERIES, DATE, "cluster", "other").agg(F.sum(((F.col("v") - F.col("value")) * F.col("factor")) ** 2).alias("d"))
    own = F.max(F.when(F.col("other") == F.col("cluster"), F.col("d")))
    return per_series(apart.groupBy(SERIES, DATE).agg(own.alias("own"), F.min("d").alias("least")), F.col("own") <= F.col("least") + 1e-4)


@query(
    "nearest_week_labels",
    "K1",
    sql_with(ctes.WEEKS, select="SELECT series_id, count(DISTINCT date) AS n_days, true AS holds FROM weeks GROUP BY 1"),
)
def nearest_week_labels(spark, sf_dir):
    fit = inputs.cached("weeks", fit_weeks, spark, sf_dir)
    return nearest_labels(fit.assign(inputs.weekly_profiles(spark, sf_dir)), fit)


@query("nearest_vector_labels", "K7", "SELECT 'all' AS series_id, count(*) AS n_days, true AS holds FROM embeddings")
def nearest_vector_labels(spark, sf_dir):
    fit = inputs.cached("vectors", fit_vectors, spark, sf_dir)
    return nearest_labels(fit.assign(inputs.labelled_vectors(spark, sf_dir)), fit)


TRAIN_RANGE = sql_with(ctes.ORDER_DAYS, select="SELECT series_id, true AS holds FROM order_days GROUP BY 1")


@query("forest_score_range", "M4 M9", TRAIN_RANGE)
def forest_score_range(spark, sf_dir):
    """A forest's prediction lies inside the range of the target it was trained on."""
    scores = forest_scores(spark, sf_dir)
    span = scores.where("split = 'train'").agg(F.min(TARGET).alias("low"), F.max(TARGET).alias("high")).first()
    return per_series(scores, F.col("prediction").between(span["low"] - 1e-6, span["high"] + 1e-6)).drop("n_days")


@query("boosted_score_keys", "M5", TRAIN_RANGE)
def boosted_score_keys(spark, sf_dir):
    """The boosted trees score every row that the forest scores."""
    both = boosted_scores(spark, sf_dir).join(forest_scores(spark, sf_dir).select(SERIES, DATE, F.lit(True).alias("known")), [SERIES, DATE], "full")
    return per_series(both, F.col("known") & F.col("prediction").isNotNull()).drop("n_days")


@query("importance_total", "M6 V9", "SELECT count(*) > 0 AS holds, 1.0::DOUBLE AS total FROM orders")
def importance_total(spark, sf_dir):
    fit = fitted(spark, sf_dir)
    table = model.importance_table(fit.model, fit.inputs, spark)
    return table.agg((F.count("*") == len(fit.inputs)).alias("holds"), F.round(F.sum("importance"), 6).alias("total"))


@query("fold_scores", "M8", "SELECT CAST(range + 1 AS INTEGER) AS fold, true AS holds FROM range(5)")
def fold_scores(spark, sf_dir):
    return cross_validation(spark, sf_dir).select("fold", ((F.col("mae") > 0) & (F.col("cv_mae") > 0)).alias("holds"))


@query(
    "scored_actuals",
    "M10",
    sql_with(ctes.ORDER_DAYS, select="SELECT series_id, true AS holds FROM order_days GROUP BY 1"),
)
def scored_actuals(spark, sf_dir):
    """Each scored request shows the actual of its day."""
    days = inputs.written_order_days(spark, sf_dir).select(SERIES, DATE, F.col(TARGET).alias("actual"))
    scored = score_dates(spark, sf_dir).join(days, [SERIES, DATE], "left")
    return per_series(scored, (F.abs(F.col(TARGET) - F.col("actual")) < 1e-6) & F.col("prediction").isNotNull()).drop("n_days")


def grid_sql(first: int, last: int) -> str:
    return sql_with(
        ctes.ORDER_DAYS,
        select=f"""SELECT series_id, {last - first + 1} AS n_days, CAST(max(date) + {first} AS VARCHAR) AS first_date,
        CAST(max(date) + {last} AS VARCHAR) AS last_date, true AS holds FROM order_days GROUP BY 1""",
    )


def grid(rows: DataFrame, holds) -> DataFrame:
    return rows.groupBy(SERIES).agg(
        F.count("*").cast("int").alias("n_days"), F.min(DATE).alias("first_date"), F.max(DATE).alias("last_date"), F.bool_and(holds).alias("holds")
    )


def inside_interval():
    spread = F.col("uncertainty") * 1.96
    low = F.greatest(F.lit(0.0), F.col("prediction") - spread)
    return (F.abs(F.col("ci_lower") - low) < 1e-6) & (F.abs(F.col("ci_upper") - F.col("prediction") - spread) < 1e-6) & (F.col("prediction") >= 0)


@query("recursive_forecast_grid", "R1 R2", grid_sql(1, 30))
def recursive_forecast_grid(spark, sf_dir):
    return grid(recursive_forecast(spark, sf_dir), inside_interval() & (F.col("days_ahead") >= 1))


@query("range_forecast_grid", "R3", grid_sql(8, 60))
def range_forecast_grid(spark, sf_dir):
    return grid(range_forecast(spark, sf_dir), inside_interval() & F.col("days_ahead").between(8, 60))


@query("seasonal_forecast_grid", "R9", grid_sql(8, 60))
def seasonal_forecast_grid(spark, sf_dir):
    return grid(seasonal_forecast(spark, sf_dir), F.col("days_ahead").between(8, 60) & F.col("prediction").isNotNull())


@query("seasonal_model_keys", "R7", sql_with(ctes.ORDER_DAYS, select="SELECT series_id, 1 AS n_days, CAST(max(date) AS VARCHAR) AS last_date, true AS holds FROM order_days GROUP BY 1"))
def seasonal_model_keys(spark, sf_dir):
    fits = seasonal_models(spark, sf_dir)
    return fits.groupBy(SERIES).agg(
        F.count("*").cast("int").alias("n_days"), F.max("last_date").alias("last_date"), F.bool_and((F.col("sigma") > 0) & F.col("aic").isNotNull()).alias("holds")
    )


@query("seasonal_order_grid", "R8", sql_with(ctes.ORDER_DAYS, select="SELECT series_id, 18 AS orders, true AS holds FROM order_days GROUP BY 1"))
def seasonal_order_grid(spark, sf_dir):
    fits = seasonal_order_search(spark, sf_dir)
    return fits.groupBy(SERIES).agg(
        F.countDistinct("p", "d", "q").cast("int").alias("orders"), F.bool_and(F.col("aic").isNotNull() == F.col("reason").isNull()).alias("holds")
    )


@query(
    "seasonal_backtest_days",
    "R11",
    sql_with(ctes.ORDER_DAYS, select="SELECT series_id, CAST(count(*) - floor(count(*) * 0.8) AS BIGINT) AS n, true AS holds FROM order_days GROUP BY 1"),
)
def seasonal_backtest_days(spark, sf_dir):
    return seasonal_backtest(spark, sf_dir).select(SERIES, "n", ((F.col("mae") > 0) & (F.col("rmse") >= F.col("mae"))).alias("holds"))


@query(
    "answered_future_requests",
    "M12",
    sql_with(
        ctes.ORDER_DAYS,
        "ends AS (SELECT series_id, max(date) AS last_date FROM order_days GROUP BY 1)",
        """asked AS (SELECT o_orderkey AS request_id, o_orderpriority AS series_id,
        CASE WHEN o_orderstatus = 'P' THEN CAST(CAST(o_orderdate AS DATE) + INTERVAL 6 MONTH AS DATE) ELSE CAST(o_orderdate AS DATE) END AS date FROM orders)""",
        select="""SELECT request_id, a.series_id, CAST(a.date AS VARCHAR) AS date, CAST(a.date - last_date AS INTEGER) AS days_ahead,
        CASE WHEN a.date - last_date > 365 THEN 'too_far' ELSE 'ok' END AS status, a.date - last_date <= 365 AS answered
        FROM asked a JOIN ends e ON e.series_id = a.series_id WHERE a.date > last_date""",
    ),
)
def answered_future_requests(spark, sf_dir):
    ahead = answer_requests(spark, sf_dir).where(F.col("days_ahead") > 0)
    return ahead.select("request_id", SERIES, DATE, "days_ahead", "status", F.col("prediction").isNotNull().alias("answered"))


@query("model_roundtrip_equal", "S4", TRAIN_RANGE)
def model_roundtrip_equal(spark, sf_dir):
    return per_series(model_roundtrip(spark, sf_dir), F.col("same")).drop("n_days")


@query(
    "daily_export",
    "S5",
    sql_with(
        ctes.ORDER_DAYS,
        select="SELECT series_id, CAST(date AS VARCHAR) AS date, round(total_daily_consumption, 6) AS total_daily_consumption FROM order_days",
    ),
)
def daily_export(spark, sf_dir):
    """The daily table written as CSV and read again."""
    days = inputs.order_days(spark, sf_dir).select(SERIES, DATE, TARGET)
    path = work_path(spark, "export")
    tables.export_csv(days, path)
    return spark.read.option("header", True).schema(days.schema).csv(path)


@query(
    "sampled_members",
    "V7",
    sql_with(
        ctes.WEEKS,
        "sizes AS (SELECT cluster, count(*) AS n FROM (SELECT DISTINCT series_id, date, cluster FROM weeks) GROUP BY 1)",
        select="SELECT cluster, least(n, 5) AS sampled FROM sizes",
    ),
)
def sampled_members(spark, sf_dir):
    picked = sample_profiles(spark, sf_dir).select(SERIES, DATE, "cluster").distinct()
    known = inputs.clustered_weeks(spark, sf_dir).select(SERIES, DATE, "cluster")
    return picked.join(known, [SERIES, DATE, "cluster"], "left_semi").groupBy("cluster").agg(F.count("*").alias("sampled"))


@query(
    "run_report_dates",
    "V18",
    """SELECT l_returnflag || l_linestatus AS series_id, CAST(min(CAST(l_shipdate AS DATE)) AS VARCHAR) AS first_date,
    CAST(max(CAST(l_shipdate AS DATE)) AS VARCHAR) AS last_date, true AS holds FROM lineitem GROUP BY 1""",
)
def run_report_dates(spark, sf_dir):
    report = run_report(spark, sf_dir)
    adds_up = F.col("clean_days") + F.col("anomalies_removed") == F.col("total_days")
    return report.select(SERIES, "first_date", "last_date", adds_up.alias("holds"))


@query(
    "cluster_count_candidates",
    "K2",
    """SELECT CAST(k AS INTEGER) AS k, true AS holds FROM (SELECT unnest(range(2, 11)) AS k) WHERE k < least(11, (SELECT count(*) // 10 FROM embeddings))""",
)
def cluster_count_candidates(spark, sf_dir):
    """Every candidate up to a tenth of the vectors has a cost and a silhouette, and one of them or between is chosen."""
    _, table = cluster.choose_k(inputs.labelled_vectors(spark, sf_dir), 10)
    holds = (F.col("cost") > 0) & F.col("silhouette").between(-1, 1) & F.col("chosen_k").between(2, 10)
    return table.select("k", holds.alias("holds"))


@query(
    "silhouette_range",
    "K3",
    sql_with(ctes.WEEKS, select="SELECT count(*) AS n_profiles, true AS holds FROM (SELECT DISTINCT series_id, date FROM weeks)"),
)
def silhouette_range(spark, sf_dir):
    return cluster_silhouette(spark, sf_dir).select("n_profiles", F.col("silhouette").between(-1, 1).alias("holds"))
