"""Anomalies, clustering, similar days."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import ctes, inputs
from catalog.registry import query, sql_with
from hourloom.config import DATE, ISOLATION_FEATURES, SERIES, TARGET, AnomalyConfig
from hourloom.operators import anomaly, cluster, isolation, resample

DEFAULT_FLAGS = ctes.flags("fleet_days", "flagged", 2.5, 3.0)
STATISTICAL = ("anomaly_iqr", "anomaly_zscore")


# ---------------------------------------------------------------- single methods


@query(
    "iqr_anomalies",
    "N1",
    sql_with(
        ctes.FLEET_DAYS,
        DEFAULT_FLAGS,
        select="SELECT series_id, CAST(date AS VARCHAR) AS date, round(total_daily_consumption, 6) AS total_daily_consumption, anomaly_iqr FROM flagged",
    ),
)
def iqr_anomalies(spark, sf_dir):
    flagged = anomaly.statistical_flags(inputs.fleet_days(spark, sf_dir), TARGET, "iqr", 2.5)
    return flagged.select(SERIES, DATE, TARGET, "anomaly_iqr")


@query(
    "zscore_anomalies",
    "N2",
    sql_with(
        ctes.FLEET_DAYS,
        DEFAULT_FLAGS,
        select="SELECT series_id, CAST(date AS VARCHAR) AS date, round(total_daily_consumption, 6) AS total_daily_consumption, anomaly_zscore FROM flagged",
    ),
)
def zscore_anomalies(spark, sf_dir):
    flagged = anomaly.statistical_flags(inputs.fleet_days(spark, sf_dir), TARGET, "zscore", 3.0)
    return flagged.select(SERIES, DATE, TARGET, "anomaly_zscore")


@query("isolation_anomalies", "N3")
def isolation_anomalies(spark, sf_dir):
    flagged = isolation.isolation_flags(inputs.order_days(spark, sf_dir))
    return flagged.select(SERIES, DATE, TARGET, "anomaly_isolation_forest")


@query("isolation_scores", "N9")
def isolation_scores(spark, sf_dir):
    flagged = isolation.isolation_flags(inputs.order_days(spark, sf_dir), ISOLATION_FEATURES)
    return flagged.select(SERIES, DATE, "isolation_score")


@query(
    "pattern_anomalies",
    "N4",
    sql_with(
        ctes.WEEKS,
        ctes.pattern("weeks", "deviations"),
        select="SELECT series_id, CAST(date AS VARCHAR) AS date, round(max_deviation, 6) AS max_deviation, anomaly_pattern FROM deviations",
    ),
)
def pattern_anomalies(spark, sf_dir):
    scored = anomaly.pattern_deviation(inputs.weekly_profiles(spark, sf_dir), n_slots=7)
    return scored.select(SERIES, DATE, "max_deviation", "anomaly_pattern")


POWER_ONLY = ["Global_active_power"]
FILLED_DAYS = [
    ctes.filled(POWER_ONLY),
    ctes.hourly("filled", POWER_ONLY, [], "hourly"),
    """power_days AS (SELECT series_id, CAST(hour_ts AS DATE) AS date, coalesce(sum(Global_active_power), 0) AS total_daily_consumption,
    CAST(isodow(CAST(hour_ts AS DATE)) - 1 AS INTEGER) AS day_of_week FROM hourly GROUP BY ALL)""",
    """day_cells AS (SELECT h.series_id, CAST(h.hour_ts AS DATE) AS date, h.hour, h.Global_active_power AS v, h.day_of_week FROM hourly h
    JOIN (SELECT series_id, CAST(hour_ts AS DATE) AS date FROM hourly GROUP BY 1, 2 HAVING count(Global_active_power) = 24) w
    ON w.series_id = h.series_id AND w.date = CAST(h.hour_ts AS DATE))""",
    ctes.pattern("day_cells", "deviations", "hour"),
]


@query(
    "hourly_pattern_flags",
    "N4 N5",
    sql_with(
        *FILLED_DAYS,
        select="""SELECT d.series_id, CAST(d.date AS VARCHAR) AS date, round(total_daily_consumption, 6) AS total_daily_consumption,
        coalesce(p.anomaly_pattern, false) AS anomaly_pattern
        FROM power_days d LEFT JOIN deviations p ON p.series_id = d.series_id AND p.date = d.date""",
    ),
)
def hourly_pattern_flags(spark, sf_dir):
    hourly = inputs.filled_hourly(spark, sf_dir)
    daily, profiles = resample.daily_summary(hourly), resample.daily_profiles(hourly)
    aligned = anomaly.align_flags(daily, anomaly.pattern_deviation(profiles), "anomaly_pattern")
    return aligned.select(SERIES, DATE, TARGET, "anomaly_pattern")


# ---------------------------------------------------------------- vote

VOTE = "CAST(anomaly_iqr AS INTEGER) + CAST(anomaly_zscore AS INTEGER)"


@query(
    "statistical_vote",
    "N6",
    sql_with(
        ctes.ORDER_DAYS,
        ctes.flags("order_days", "flagged", 2.5, 3.0),
        select=f"""SELECT series_id, CAST(date AS VARCHAR) AS date, round(total_daily_consumption, 6) AS total_daily_consumption,
        anomaly_iqr, anomaly_zscore, {VOTE} AS anomaly_count, {VOTE} >= 1 AS is_anomaly FROM flagged""",
    ),
)
def statistical_vote(spark, sf_dir):
    flagged = anomaly.both_statistical_flags(inputs.order_days(spark, sf_dir), AnomalyConfig())
    voted = anomaly.vote(flagged, STATISTICAL, 1)
    return voted.select(SERIES, DATE, TARGET, *STATISTICAL, "anomaly_count", "is_anomaly")


THREE = VOTE + " + CAST(anomaly_pattern AS INTEGER)"


@query(
    "three_way_vote",
    "N5 N6",
    sql_with(
        *FILLED_DAYS,
        ctes.flags("power_days", "flagged", 2.5, 3.0),
        """voted AS (SELECT f.*, coalesce(p.anomaly_pattern, false) AS anomaly_pattern
        FROM flagged f LEFT JOIN deviations p ON p.series_id = f.series_id AND p.date = f.date)""",
        select=f"""SELECT series_id, CAST(date AS VARCHAR) AS date, anomaly_iqr, anomaly_zscore, anomaly_pattern,
        {THREE} AS anomaly_count, {THREE} >= 2 AS is_anomaly FROM voted""",
    ),
)
def three_way_vote(spark, sf_dir):
    hourly = inputs.filled_hourly(spark, sf_dir)
    flagged = anomaly.both_statistical_flags(resample.daily_summary(hourly))
    pattern = anomaly.pattern_deviation(resample.daily_profiles(hourly))
    flags = (*STATISTICAL, "anomaly_pattern")
    voted = anomaly.vote(anomaly.align_flags(flagged, pattern, "anomaly_pattern"), flags, 2)
    return voted.select(SERIES, DATE, *flags, "anomaly_count", "is_anomaly")


@query("four_way_vote", "N6")
def four_way_vote(spark, sf_dir):
    hourly = inputs.filled_hourly(spark, sf_dir)
    voted = anomaly.detect_anomalies(resample.daily_summary(hourly), resample.daily_profiles(hourly))
    return voted.select(
        SERIES, DATE, *STATISTICAL, "anomaly_isolation_forest", "anomaly_pattern", "anomaly_count", "is_anomaly"
    )


@query(
    "anomaly_summary",
    "N7",
    sql_with(
        ctes.FLAGGED_FLEET,
        select="""SELECT series_id, count(*) AS total_days, count(*) FILTER (is_anomaly) AS anomalies_detected,
        round(count(*) FILTER (is_anomaly) / count(*) * 100, 6) AS anomaly_percentage FROM flagged_fleet GROUP BY 1""",
    ),
)
def anomaly_summary(spark, sf_dir):
    return anomaly.anomaly_summary(inputs.flagged_fleet(spark, sf_dir))


METHOD_SQL = """SELECT series_id, 'iqr' AS method, count(*) FILTER (anomaly_iqr) AS n_days FROM flagged_fleet GROUP BY 1
UNION ALL SELECT series_id, 'zscore', count(*) FILTER (anomaly_zscore) FROM flagged_fleet GROUP BY 1"""


@query("anomalies_by_method", "N7", sql_with(ctes.FLAGGED_FLEET, select=METHOD_SQL))
def anomalies_by_method(spark, sf_dir):
    return anomaly.method_counts(inputs.flagged_fleet(spark, sf_dir), STATISTICAL)


@query(
    "clean_days",
    "N8",
    sql_with(
        ctes.FLAGGED_FLEET,
        select="""SELECT series_id, CAST(date AS VARCHAR) AS date, round(total_daily_consumption, 6) AS total_daily_consumption
        FROM flagged_fleet WHERE NOT is_anomaly""",
    ),
)
def clean_days(spark, sf_dir):
    return anomaly.clean_days(inputs.flagged_fleet(spark, sf_dir)).select(SERIES, DATE, TARGET)


# ---------------------------------------------------------------- clusters

def fit_weeks(spark, sf_dir):
    return cluster.fit_profile_clusters(inputs.weekly_profiles(spark, sf_dir), 5)


def fit_vectors(spark, sf_dir):
    return cluster.fit_profile_clusters(inputs.labelled_vectors(spark, sf_dir), 10)


@query("cluster_profiles", "K1")
def cluster_profiles(spark, sf_dir):
    weeks = inputs.weekly_profiles(spark, sf_dir)
    return inputs.cached("weeks", fit_weeks, spark, sf_dir).assign(weeks).select(SERIES, DATE, "cluster")


@query("choose_cluster_count", "K2")
def choose_cluster_count(spark, sf_dir):
    _, table = cluster.choose_k(inputs.weekly_profiles(spark, sf_dir), 10)
    return table


@query("cluster_silhouette", "K3")
def cluster_silhouette(spark, sf_dir):
    weeks = inputs.weekly_profiles(spark, sf_dir)
    score = cluster.cluster_silhouette(weeks, inputs.cached("weeks", fit_weeks, spark, sf_dir))
    return weeks.agg(F.count("*").alias("n_profiles")).withColumn("silhouette", F.lit(score))


@query("cluster_centers", "K4")
def cluster_centers(spark, sf_dir):
    centers = inputs.cached("weeks", fit_weeks, spark, sf_dir).centers_table(spark)
    return centers.select("cluster", F.posexplode("center").alias("hour", "value"))


@query(
    "cluster_characteristics",
    "K5",
    sql_with(
        ctes.WEEKS,
        "curves AS (SELECT cluster, slot, avg(v) AS m FROM weeks GROUP BY 1, 2)",
        """ends AS (SELECT cluster, CAST(arg_max(slot, struct_pack(m := m, s := -slot)) AS INTEGER) AS peak_hour, max(m) AS peak_value,
        CAST(arg_min(slot, struct_pack(m := m, s := slot)) AS INTEGER) AS min_hour, min(m) AS min_value FROM curves GROUP BY 1)""",
        "levels AS (SELECT cluster, avg(v) AS avg_consumption, stddev_pop(v) AS volatility FROM weeks GROUP BY 1)",
        """days AS (SELECT cluster, count(*) AS n_days, 100.0 * count(*) FILTER (is_weekend = 0) / count(*) AS pct_weekdays,
        100.0 * count(*) FILTER (is_weekend = 1) / count(*) AS pct_weekends,
        mode(season ORDER BY season) AS dominant_season FROM weeks WHERE slot = 0 GROUP BY 1)""",
        select="""SELECT d.cluster, n_days, round(pct_weekdays, 6) AS pct_weekdays, round(pct_weekends, 6) AS pct_weekends,
        round(avg_consumption, 6) AS avg_consumption, round(volatility, 6) AS volatility, peak_hour, round(peak_value, 6) AS peak_value,
        min_hour, round(min_value, 6) AS min_value, dominant_season
        FROM days d JOIN levels USING (cluster) JOIN ends USING (cluster)""",
    ),
)
def cluster_characteristics(spark, sf_dir):
    return cluster.cluster_characteristics(inputs.clustered_weeks(spark, sf_dir))


@query(
    "typical_profiles",
    "K6",
    sql_with(ctes.WEEKS, select="SELECT cluster, slot AS hour, round(avg(v), 6) AS v FROM weeks GROUP BY 1, 2"),
)
def typical_profiles(spark, sf_dir):
    typical = cluster.typical_profiles(inputs.clustered_weeks(spark, sf_dir))
    return typical.select("cluster", F.posexplode("profile").alias("hour", "v"))


@query("assign_new_profiles", "K7")
def assign_new_profiles(spark, sf_dir):
    vectors = inputs.labelled_vectors(spark, sf_dir)
    return inputs.cached("vectors", fit_vectors, spark, sf_dir).assign(vectors).select(SERIES, DATE, "label", "cluster")


@query(
    "similar_days",
    "K8",
    sql_with(
        ctes.WEEKS,
        "vectors AS (SELECT series_id, date, cluster, day_of_week, list(v ORDER BY slot) AS p FROM weeks GROUP BY ALL)",
        "targets AS (SELECT series_id, cluster, max(date) AS date FROM vectors GROUP BY 1, 2)",
        """pairs AS (SELECT t.series_id, t.date, c.date AS similar_date, c.day_of_week = x.day_of_week AS same_weekday,
          list_distance(x.p, c.p) AS d
        FROM targets t JOIN vectors x ON x.series_id = t.series_id AND x.date = t.date
        JOIN vectors c ON c.series_id = x.series_id AND c.cluster = x.cluster AND c.date <> x.date)""",
        "preferred AS (SELECT *, bool_or(same_weekday) OVER (PARTITION BY series_id, date) AS any_same FROM pairs)",
        """ranked AS (SELECT *, row_number() OVER (PARTITION BY series_id, date ORDER BY d, similar_date) AS rank
        FROM preferred WHERE same_weekday OR NOT any_same)""",
        select="""SELECT series_id, CAST(date AS VARCHAR) AS date, CAST(similar_date AS VARCHAR) AS similar_date, same_weekday,
        round(d, 6) AS similarity_distance, CAST(rank AS INTEGER) AS rank, 'ok' AS status FROM ranked WHERE rank <= 10""",
    ),
)
def similar_days(spark, sf_dir):
    weeks = inputs.clustered_weeks(spark, sf_dir)
    latest = weeks.groupBy(SERIES, "cluster").agg(F.max(DATE).alias(DATE)).select(SERIES, DATE)
    return cluster.similar_days(weeks, latest, 10)


