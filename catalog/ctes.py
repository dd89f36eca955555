"""SQL twins of the engine tables in `inputs`, as WITH entries."""

MEANS = ["Global_active_power", "Global_reactive_power", "Voltage", "Global_intensity"]
SUMS = ["Sub_metering_1", "Sub_metering_2", "Sub_metering_3"]
MEASURES = MEANS + SUMS

MINUTES = """
minutes AS (
  SELECT event_type AS series_id, date_trunc('minute', ts) AS ts,
    avg(value) * 0.0103141592653 AS Global_active_power,
    min(value) * 0.00103141592653 AS Global_reactive_power,
    max(value) * 0.0103141592653 + 230 AS Voltage,
    sum(value) * 0.0434897932384 AS Global_intensity,
    sum(CASE WHEN value < 20 THEN value END) * 0.0103141592653 AS Sub_metering_1,
    sum(CASE WHEN value >= 20 AND value < 60 THEN value END) * 0.0103141592653 AS Sub_metering_2,
    sum(CASE WHEN value >= 60 THEN value END) * 0.0103141592653 AS Sub_metering_3
  FROM events GROUP BY 1, 2)"""

READINGS = MINUTES + """,
span AS (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM minutes GROUP BY 1),
spine AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 1 MINUTE)) AS ts FROM span),
readings AS (
  SELECT s.series_id, s.ts, m.* EXCLUDE (series_id, ts)
  FROM spine s LEFT JOIN minutes m ON m.series_id = s.series_id AND m.ts = s.ts)"""


def filled(measures: list[str]) -> str:
    """The three passes of the gap filler, one after another."""
    seen = ",\n".join(
        f"max(CASE WHEN {m} IS NOT NULL THEN rn END) OVER (PARTITION BY series_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS p_{m},\n"
        f"min(CASE WHEN {m} IS NOT NULL THEN rn END) OVER (PARTITION BY series_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n_{m}"
        for m in measures
    )
    lines = ",\n".join(
        f"CASE WHEN a.{m} IS NOT NULL THEN a.{m} WHEN a.rn - a.p_{m} <= 60 THEN CASE WHEN a.n_{m} IS NULL THEN p{i}.{m} "
        f"ELSE p{i}.{m} + (n{i}.{m} - p{i}.{m}) * (a.us - p{i}.us) / (n{i}.us - p{i}.us) END END AS {m}"
        for i, m in enumerate(measures)
    )
    joins = "\n".join(
        f"LEFT JOIN numbered p{i} ON p{i}.series_id = a.series_id AND p{i}.rn = a.p_{m}\n"
        f"LEFT JOIN numbered n{i} ON n{i}.series_id = a.series_id AND n{i}.rn = a.n_{m}"
        for i, m in enumerate(measures)
    )
    held = ", ".join(
        f"coalesce({m}, last_value({m} IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY rn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) AS {m}"
        for m in measures
    )
    back = ", ".join(
        f"coalesce({m}, first_value({m} IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)) AS {m}"
        for m in measures
    )
    return READINGS + f""",
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn, CAST(epoch_us(ts) AS DOUBLE) AS us FROM readings),
around AS (SELECT *, {seen} FROM numbered),
lined AS (SELECT a.series_id, a.ts, a.rn, {lines} FROM around a {joins}),
held AS (SELECT series_id, ts, rn, {held} FROM lined),
filled AS (SELECT series_id, ts, {back} FROM held)"""


def hourly(source: str, means: list[str] = MEANS, sums: list[str] = SUMS, name: str = "hourly") -> str:
    """Dense hours with calendar fields."""
    agg = ", ".join([f"avg({m}) AS {m}" for m in means] + [f"sum({m}) AS {m}" for m in sums])
    out = ", ".join([f"k.{m}" for m in means] + [f"coalesce(k.{m}, 0) AS {m}" for m in sums])
    return f"""
hours AS (SELECT series_id, date_trunc('hour', ts) AS hour_ts, {agg}, count(*) AS n_readings FROM {source} GROUP BY 1, 2),
hour_span AS (SELECT series_id, min(hour_ts) AS lo, max(hour_ts) AS hi FROM hours GROUP BY 1),
hour_spine AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour_ts FROM hour_span),
{name} AS (
  SELECT s.series_id, s.hour_ts, {out}, coalesce(k.n_readings, 0) AS n_readings,
    CAST(hour(s.hour_ts) AS INTEGER) AS hour, CAST(isodow(s.hour_ts) - 1 AS INTEGER) AS day_of_week,
    CAST(day(s.hour_ts) AS INTEGER) AS day_of_month, CAST(month(s.hour_ts) AS INTEGER) AS month,
    CAST(year(s.hour_ts) AS INTEGER) AS year,
    CASE WHEN isodow(s.hour_ts) >= 6 THEN 1 ELSE 0 END AS is_weekend,
    CAST((month(s.hour_ts) % 12) // 3 AS INTEGER) AS season
  FROM hour_spine s LEFT JOIN hours k ON k.series_id = s.series_id AND k.hour_ts = s.hour_ts)"""


ORDER_ROWS = """
order_rows AS (
  SELECT o_orderpriority AS series_id, o_orderdate AS hour_ts, o_totalprice * 0.00100314159265 AS Global_active_power,
    o_totalprice * 0.000100314159265 AS Global_reactive_power, o_custkey * 0.000991593628 + 230 AS Voltage, o_totalprice * 0.00436781659214 AS Global_intensity,
    CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 0.00100314159265 END AS Sub_metering_1,
    CASE WHEN o_orderstatus = 'O' THEN o_totalprice * 0.00100314159265 END AS Sub_metering_2,
    CASE WHEN o_orderstatus = 'P' THEN o_totalprice * 0.00100314159265 END AS Sub_metering_3
  FROM orders)"""


def line_rows(series: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT {series} AS series_id, l_shipdate AS hour_ts, l_extendedprice * 0.00100314159265 AS Global_active_power,
    l_extendedprice * 0.00100314159265 * l_discount AS Global_reactive_power, l_quantity * 0.14285314159265 + 230 AS Voltage,
    l_extendedprice * 0.00436781659214 AS Global_intensity,
    CASE WHEN l_returnflag = 'R' THEN l_extendedprice * 0.00100314159265 END AS Sub_metering_1,
    CASE WHEN l_returnflag = 'A' THEN l_extendedprice * 0.00100314159265 END AS Sub_metering_2,
    CASE WHEN l_returnflag = 'N' THEN l_extendedprice * 0.00100314159265 END AS Sub_metering_3
  FROM lineitem)"""


def daily(source: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT series_id, CAST(hour_ts AS DATE) AS date,
    avg(Global_active_power) AS avg_hourly_consumption, stddev_samp(Global_active_power) AS consumption_volatility,
    min(Global_active_power) AS min_consumption, max(Global_active_power) AS peak_consumption,
    coalesce(sum(Global_active_power), 0) AS total_daily_consumption,
    avg(Global_reactive_power) AS Global_reactive_power_mean, coalesce(sum(Global_reactive_power), 0) AS Global_reactive_power_sum,
    avg(Voltage) AS Voltage_mean, stddev_samp(Voltage) AS Voltage_std,
    avg(Global_intensity) AS Global_intensity_mean, max(Global_intensity) AS Global_intensity_max,
    coalesce(sum(Sub_metering_1), 0) AS Sub_metering_1_sum, coalesce(sum(Sub_metering_2), 0) AS Sub_metering_2_sum,
    coalesce(sum(Sub_metering_3), 0) AS Sub_metering_3_sum, count(Global_active_power) AS n_hours,
    CAST(isodow(CAST(hour_ts AS DATE)) - 1 AS INTEGER) AS day_of_week,
    CASE WHEN isodow(CAST(hour_ts AS DATE)) >= 6 THEN 1 ELSE 0 END AS is_weekend,
    CAST(month(CAST(hour_ts AS DATE)) AS INTEGER) AS month,
    CAST((month(CAST(hour_ts AS DATE)) % 12) // 3 AS INTEGER) AS season,
    CAST(year(CAST(hour_ts AS DATE)) AS INTEGER) AS year
  FROM {source} GROUP BY series_id, CAST(hour_ts AS DATE))"""


ORDER_DAYS = ORDER_ROWS + "," + daily("order_rows", "order_days")
FLEET_DAYS = line_rows("CAST(l_suppkey AS VARCHAR)", "fleet_rows") + "," + daily("fleet_rows", "fleet_days")

DAILY_COLUMNS = (
    "series_id date:s avg_hourly_consumption:r consumption_volatility:r min_consumption:r peak_consumption:r "
    "total_daily_consumption:r Global_reactive_power_mean:r Global_reactive_power_sum:r Voltage_mean:r Voltage_std:r "
    "Global_intensity_mean:r Global_intensity_max:r Sub_metering_1_sum:r Sub_metering_2_sum:r Sub_metering_3_sum:r "
    "n_hours:l day_of_week is_weekend month season year"
)

METADATA = """CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
    CAST(month(date) AS INTEGER) AS month, CAST((month(date) % 12) // 3 AS INTEGER) AS season"""

# weeks: one row per complete week and slot, with metadata and the stand-in cluster
WEEKS = line_rows("l_returnflag || l_linestatus", "week_rows") + f""",
week_cells AS (
  SELECT series_id, CAST(date_trunc('week', hour_ts) AS DATE) AS date, CAST(isodow(hour_ts) - 1 AS INTEGER) AS slot,
    avg(Global_active_power) AS v FROM week_rows GROUP BY 1, 2, 3),
whole_weeks AS (SELECT series_id, date FROM week_cells GROUP BY 1, 2 HAVING count(v) = 7),
weeks AS (
  SELECT c.series_id, c.date, c.slot, c.v, {METADATA.replace("(date)", "(c.date)")},
    CAST(((month(c.date) % 12) // 3) * 2 + CASE WHEN day(c.date) > 15 THEN 1 ELSE 0 END AS INTEGER) AS cluster
  FROM week_cells c JOIN whole_weeks w ON w.series_id = c.series_id AND w.date = c.date)"""


def flags(source: str, name: str, iqr: float, z: float) -> str:
    """IQR and z-score flags of the target."""
    return f"""
{name}_stats AS (
  SELECT series_id, quantile_cont(total_daily_consumption, 0.25) AS q1, quantile_cont(total_daily_consumption, 0.75) AS q3,
    avg(total_daily_consumption) AS mu, stddev_pop(total_daily_consumption) AS sd
  FROM {source} GROUP BY 1),
{name} AS (
  SELECT d.*,
    coalesce(total_daily_consumption < q1 - {iqr} * (q3 - q1) OR total_daily_consumption > q3 + {iqr} * (q3 - q1), false) AS anomaly_iqr,
    CASE WHEN sd = 0 THEN false ELSE coalesce(abs(total_daily_consumption - mu) / sd > {z}, false) END AS anomaly_zscore
  FROM {source} d JOIN {name}_stats s ON s.series_id = d.series_id)"""


FLAGGED_FLEET = FLEET_DAYS + "," + flags("fleet_days", "fleet_flags", 0.75, 1.5) + """,
flagged_fleet AS (
  SELECT *, CAST(anomaly_iqr AS INTEGER) + CAST(anomaly_zscore AS INTEGER) AS anomaly_count,
    CAST(anomaly_iqr AS INTEGER) + CAST(anomaly_zscore AS INTEGER) >= 2 AS is_anomaly
  FROM fleet_flags)"""

LAG_WEEK = ORDER_DAYS + """,
lagged AS (
  SELECT series_id, date, total_daily_consumption,
    lag(total_daily_consumption, 7) OVER (PARTITION BY series_id ORDER BY date) AS prediction FROM order_days),
scored AS (SELECT * FROM lagged WHERE prediction IS NOT NULL)"""


def pattern(cells: str, name: str, slot: str = "slot") -> str:
    """Brute-force comparison of every day with the other days of its weekday."""
    return f"""
{name}_peers AS (
  SELECT a.series_id, a.date, a.{slot}, any_value(a.v) AS x, count(b.v) AS peers, avg(b.v) AS mu, stddev_samp(b.v) AS sd
  FROM {cells} a LEFT JOIN {cells} b
    ON b.series_id = a.series_id AND b.day_of_week = a.day_of_week AND b.{slot} = a.{slot} AND b.date <> a.date
  GROUP BY 1, 2, 3),
{name} AS (
  SELECT series_id, date, CASE WHEN min(peers) >= 3 THEN max(abs(x - mu) / (sd + 1e-6)) END AS max_deviation,
    coalesce(CASE WHEN min(peers) >= 3 THEN max(abs(x - mu) / (sd + 1e-6)) END > 2.5, false) AS anomaly_pattern
  FROM {name}_peers GROUP BY 1, 2)"""
