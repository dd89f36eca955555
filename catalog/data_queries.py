"""Sources, cleaning, resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import ctes, inputs
from catalog.registry import cols, query, sql_with
from hourloom.config import DATE, HOUR_TS, MEAN_MEASURES, MEASURES, SERIES, TARGET, TS
from hourloom.operators import clean, resample
from hourloom.plans import training
from hourloom.session import work_path
from hourloom.sources import meter_text, tables

READING_COLUMNS = "series_id ts:s " + " ".join(f"{m}:r" for m in ctes.MEASURES)


# ---------------------------------------------------------------- sources


def event_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a meter file, with short dates, missing marks and broken dates among them."""
    ts, v = F.col("ts"), F.col("value")
    short = F.concat_ws("/", F.dayofmonth(ts), F.month(ts), F.year(ts))
    date = F.when(v > 300, F.lit("31/02/2024")).when(v < 50, short).otherwise(F.date_format(ts, "dd/MM/yyyy"))
    number = F.format_string("%.3f", v)
    fields = [
        date,
        F.date_format(ts, "HH:mm:ss"),
        F.when(v < 5, F.lit("?")).otherwise(number),
        number,
        F.when(v > 100, F.lit("")).otherwise(number),
        F.when(v > 200, F.lit("broken")).otherwise(number),
        F.lit("0.000"),
        F.lit("1.000"),
        F.format_string("%d.000", "user_id"),
    ]
    return inputs.table(spark, sf_dir, "events").select("event_type", "event_id", F.concat_ws(";", *fields).alias("line"))


TEXT_SQL = """
parsed AS (
  SELECT event_type AS series_id, CASE WHEN value > 300 THEN NULL ELSE date_trunc('second', ts) END AS ts,
    CASE WHEN value < 5 THEN NULL ELSE value END AS Global_active_power, value AS Global_reactive_power,
    CASE WHEN value > 100 THEN NULL ELSE value END AS Voltage, CASE WHEN value > 200 THEN NULL ELSE value END AS Global_intensity,
    CAST(0 AS DOUBLE) AS Sub_metering_1, CAST(1 AS DOUBLE) AS Sub_metering_2, CAST(user_id AS DOUBLE) AS Sub_metering_3
  FROM events)"""


@query("meter_text_source", "S1", sql_with(TEXT_SQL, select=f"SELECT {cols(READING_COLUMNS)} FROM parsed"))
def meter_text_source(spark, sf_dir):
    return meter_text.parse_meter_lines(event_text(spark, sf_dir), "line", F.col("event_type"))


MISSING = " + ".join(f"count(*) - count({m})" for m in ctes.MEASURES)


@query(
    "load_report",
    "S2",
    sql_with(
        TEXT_SQL,
        select=f"""SELECT series_id, count(*) AS n_rows, CAST(min(ts) AS VARCHAR) AS first_ts, CAST(max(ts) AS VARCHAR) AS last_ts,
        CAST({MISSING} AS BIGINT) AS missing_values FROM parsed GROUP BY 1""",
    ),
)
def load_report(spark, sf_dir):
    return meter_text.load_report(meter_text_source(spark, sf_dir))


@query(
    "prepared_table_roundtrip",
    "S3",
    sql_with(ctes.FLEET_DAYS, select=f"SELECT {cols(ctes.DAILY_COLUMNS)} FROM fleet_days"),
)
def prepared_table_roundtrip(spark, sf_dir):
    root = work_path(spark, "prepared")
    tables.write_prepared({"daily": inputs.fleet_days(spark, sf_dir)}, root)
    return tables.read_prepared(spark, root, "daily")


# ---------------------------------------------------------------- cleaning


def filled_sql(measures: list[str]) -> str:
    return sql_with(ctes.filled(measures), select=f"SELECT {cols('series_id ts:s ' + ' '.join(m + ':r' for m in measures))} FROM filled")


@query("interpolate_gaps", "C1", filled_sql(["Global_active_power", "Sub_metering_3"]))
def interpolate_gaps(spark, sf_dir):
    measures = ["Global_active_power", "Sub_metering_3"]
    return clean.handle_missing(inputs.readings(spark, sf_dir).select(SERIES, TS, *measures), "interpolate", measures)


FORWARD = ", ".join(
    f"last_value({m} IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS {m}" for m in ctes.MEASURES
)


@query(
    "forward_fill",
    "C2",
    sql_with(
        ctes.READINGS,
        f"carried AS (SELECT series_id, ts, {FORWARD} FROM readings)",
        select=f"SELECT {cols(READING_COLUMNS)} FROM carried",
    ),
)
def forward_fill(spark, sf_dir):
    return clean.handle_missing(inputs.readings(spark, sf_dir), "forward_fill")


WHOLE_MEASURES = ["Global_active_power", "Voltage", "Sub_metering_1", "Sub_metering_2"]


@query(
    "drop_incomplete",
    "C3",
    sql_with(
        ctes.READINGS,
        select=f"SELECT {cols(READING_COLUMNS)} FROM readings WHERE {' AND '.join(m + ' IS NOT NULL' for m in WHOLE_MEASURES)}",
    ),
)
def drop_incomplete(spark, sf_dir):
    return clean.handle_missing(inputs.readings(spark, sf_dir), "drop", WHOLE_MEASURES)


@query(
    "impute_mean",
    "C4",
    sql_with(
        ctes.FLEET_DAYS,
        select="""SELECT series_id, CAST(date AS VARCHAR) AS date,
        round(coalesce(consumption_volatility, avg(consumption_volatility) OVER (PARTITION BY series_id)), 6) AS consumption_volatility,
        round(coalesce(Voltage_std, avg(Voltage_std) OVER (PARTITION BY series_id)), 6) AS Voltage_std FROM fleet_days""",
    ),
)
def impute_mean(spark, sf_dir):
    days = inputs.fleet_days(spark, sf_dir).select(SERIES, DATE, "consumption_volatility", "Voltage_std")
    return clean.impute_mean(days, ["consumption_volatility", "Voltage_std"])


ORDER_LABELS = """
labels_of_days AS (SELECT series_id, date, season * 2 + is_weekend AS cluster FROM order_days WHERE day_of_week < 6),
label_modes AS (
  SELECT series_id, cluster FROM (
    SELECT series_id, cluster, row_number() OVER (PARTITION BY series_id ORDER BY count(*) DESC, cluster) AS r
    FROM (SELECT d.series_id, l.cluster FROM order_days d JOIN labels_of_days l ON l.series_id = d.series_id AND l.date = d.date)
    GROUP BY series_id, cluster) WHERE r = 1),
order_labelled AS (
  SELECT d.*, CAST(coalesce(l.cluster, m.cluster, 0) AS INTEGER) AS cluster
  FROM order_days d LEFT JOIN labels_of_days l ON l.series_id = d.series_id AND l.date = d.date
  LEFT JOIN label_modes m ON m.series_id = d.series_id)"""


@query(
    "impute_mode",
    "C5",
    sql_with(ctes.ORDER_DAYS, ORDER_LABELS, select="SELECT series_id, CAST(date AS VARCHAR) AS date, cluster FROM order_labelled"),
)
def impute_mode(spark, sf_dir):
    days = inputs.order_days(spark, sf_dir).select(SERIES, DATE)
    labelled = days.join(inputs.order_clusters(spark, sf_dir), [SERIES, DATE], "left")
    return clean.impute_mode(labelled, "cluster", fallback=0)


@query(
    "zero_fill",
    "C6",
    sql_with(
        ctes.FLEET_DAYS,
        select="""SELECT series_id, CAST(date AS VARCHAR) AS date, round(coalesce(consumption_volatility, 0), 6) AS consumption_volatility,
        CAST(0 AS DOUBLE) AS lag_7d FROM fleet_days""",
    ),
)
def zero_fill(spark, sf_dir):
    days = inputs.fleet_days(spark, sf_dir).select(SERIES, DATE, "consumption_volatility")
    return clean.zero_fill(days, ["consumption_volatility", "lag_7d"])


@query(
    "drop_unusable",
    "C7",
    sql_with(
        ctes.FLEET_DAYS,
        select="""SELECT series_id, CAST(date AS VARCHAR) AS date, round(total_daily_consumption, 6) AS total_daily_consumption,
        round(consumption_volatility, 6) AS consumption_volatility FROM fleet_days
        WHERE total_daily_consumption IS NOT NULL AND consumption_volatility IS NOT NULL""",
    ),
)
def drop_unusable(spark, sf_dir):
    days = inputs.fleet_days(spark, sf_dir).select(SERIES, DATE, TARGET, "consumption_volatility")
    return clean.drop_unusable(days, TARGET, ["consumption_volatility"])


# ---------------------------------------------------------------- resampling

HOURLY_COLUMNS = "series_id hour_ts:s " + " ".join(f"{m}:r" for m in ctes.MEASURES) + " n_readings:l"
CALENDAR = "hour day_of_week day_of_month month year is_weekend season"


@query(
    "hourly_rollup",
    "A1",
    sql_with(ctes.MINUTES, ctes.hourly("minutes"), select=f"SELECT {cols(HOURLY_COLUMNS)} FROM hourly"),
)
def hourly_rollup(spark, sf_dir):
    return resample.hourly_rollup(inputs.event_minutes(spark, sf_dir))


@query(
    "hour_calendar",
    "A2",
    sql_with(ctes.MINUTES, ctes.hourly("minutes"), select=f"SELECT {cols('series_id hour_ts:s ' + CALENDAR)} FROM hourly"),
)
def hour_calendar(spark, sf_dir):
    return inputs.hourly(spark, sf_dir).select(SERIES, HOUR_TS, *CALENDAR.split())


@query(
    "daily_summary",
    "A3",
    sql_with(
        ctes.MINUTES, ctes.hourly("minutes"), ctes.daily("hourly", "days"), select=f"SELECT {cols(ctes.DAILY_COLUMNS)} FROM days"
    ),
)
def daily_summary(spark, sf_dir):
    return resample.daily_summary(inputs.hourly(spark, sf_dir))


@query(
    "fleet_daily_summary",
    "A3",
    sql_with(ctes.FLEET_DAYS, select=f"SELECT {cols(ctes.DAILY_COLUMNS)} FROM fleet_days"),
)
def fleet_daily_summary(spark, sf_dir):
    return inputs.fleet_days(spark, sf_dir)


HOUR_SLOTS = ", ".join(f"round(max(CASE WHEN hour = {h} THEN Global_active_power END), 6) AS h{h}" for h in range(24))


@query(
    "daily_profiles",
    "A4",
    sql_with(
        ctes.MINUTES,
        ctes.hourly("minutes"),
        select=f"""SELECT series_id, CAST(CAST(hour_ts AS DATE) AS VARCHAR) AS date, {HOUR_SLOTS} FROM hourly
        GROUP BY 1, 2 HAVING count(Global_active_power) = 24""",
    ),
)
def daily_profiles(spark, sf_dir):
    wide = resample.profiles_wide(resample.daily_profiles(inputs.hourly(spark, sf_dir)))
    return wide.select(SERIES, DATE, *[f"h{h}" for h in range(24)])


@query(
    "weekly_profiles",
    "A4",
    sql_with(ctes.WEEKS, select="SELECT series_id, CAST(date AS VARCHAR) AS date, slot AS hour, round(v, 6) AS v FROM weeks"),
)
def weekly_profiles(spark, sf_dir):
    return resample.profiles_long(inputs.weekly_profiles(spark, sf_dir))


@query(
    "profile_metadata",
    "A5",
    sql_with(
        ctes.MINUTES,
        ctes.hourly("minutes"),
        """whole AS (SELECT series_id, CAST(hour_ts AS DATE) AS date, sum(Global_active_power) AS total FROM hourly
        GROUP BY 1, 2 HAVING count(Global_active_power) = 24)""",
        select=f"""SELECT series_id, CAST(date AS VARCHAR) AS date, round(total, 6) AS total, {ctes.METADATA} FROM whole""",
    ),
)
def profile_metadata(spark, sf_dir):
    hourly = inputs.hourly(spark, sf_dir)
    meta = ["day_of_week", "is_weekend", "month", "season"]
    metadata = hourly.groupBy(SERIES, F.to_date(HOUR_TS).alias(DATE)).agg(*[F.min(c).alias(c) for c in meta])
    profiles = resample.daily_profiles(hourly)
    total = F.aggregate("profile", F.lit(0.0), lambda a, x: a + x)
    return resample.attach_metadata(profiles.select(SERIES, DATE, total.alias("total")), metadata)


@query(
    "prepared_daily",
    "A6",
    sql_with(
        ctes.filled(ctes.MEASURES),
        ctes.hourly("filled"),
        ctes.daily("hourly", "days"),
        """whole AS (SELECT series_id, CAST(hour_ts AS DATE) AS date, true AS has_profile FROM hourly
        GROUP BY 1, 2 HAVING count(Global_active_power) = 24)""",
        select=f"""SELECT {cols(ctes.DAILY_COLUMNS.replace('series_id ', '').replace('date:s ', ''))}, d.series_id,
        CAST(d.date AS VARCHAR) AS date, coalesce(has_profile, false) AS has_profile
        FROM days d LEFT JOIN whole w ON w.series_id = d.series_id AND w.date = d.date""",
    ),
)
def prepared_daily(spark, sf_dir):
    _, daily, profiles = training.prepare(inputs.readings(spark, sf_dir))
    marked = daily.join(profiles.select(SERIES, DATE, F.lit(True).alias("has_profile")), [SERIES, DATE], "left")
    return marked.withColumn("has_profile", F.coalesce("has_profile", F.lit(False)))


assert MEAN_MEASURES + tuple(ctes.SUMS) == MEASURES
