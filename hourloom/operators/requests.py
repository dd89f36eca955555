"""Request text to dates, and horizon checks, as column expressions over request tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.config import DATE, MAX_HORIZON_DAYS, SERIES

# Day offsets behind the keywords, checked in this order.
KEYWORD_OFFSETS = (("tomorrow", 1), ("today", None), ("yesterday", None), ("next week", 7), ("next month", 30))


def anchor_dates(daily: DataFrame, latest_offset: int = 10) -> DataFrame:
    """Per series: last day, the `latest_offset`-th last day ("today") and the one before ("yesterday")."""
    back = F.row_number().over(Window.partitionBy(SERIES).orderBy(F.desc(DATE)))
    days = daily.select(SERIES, DATE, back.alias("_back")).where(F.col("_back") <= latest_offset + 1)

    def nth(k: int) -> Column:
        return F.max(F.when(F.col("_back") == k, F.col(DATE)))

    return days.groupBy(SERIES).agg(
        nth(1).alias("last_date"), nth(latest_offset).alias("latest"), nth(latest_offset + 1).alias("before_latest")
    )


def resolve_requests(requests: DataFrame, anchors: DataFrame) -> DataFrame:
    """Adds `date`, `days_ahead` and `status` to (series_id, query) rows.

    Keywords count from the series' last day; "today" and an empty query mean its latest usable day.
    Dates are YYYY-MM-DD or DD/MM/YYYY.
    """
    text = F.lower(F.col("query"))
    iso = F.regexp_extract("query", r"(\d{4}-\d{2}-\d{2})", 1)
    slashed = F.regexp_extract("query", r"(\d{2}/\d{2}/\d{4})", 1)
    after = {word: F.date_add("last_date", days) for word, days in KEYWORD_OFFSETS if days is not None}
    meaning = {**after, "today": F.col("latest"), "yesterday": F.col("before_latest")}

    resolved = F.when(F.coalesce(F.length(F.trim("query")), F.lit(0)) == 0, F.col("latest"))
    for word, _ in KEYWORD_OFFSETS:
        resolved = resolved.when(text.contains(word), meaning[word])
    day_first = F.concat_ws("-", F.substring(slashed, 7, 4), F.substring(slashed, 4, 2), F.substring(slashed, 1, 2))
    resolved = resolved.when(iso != "", iso.try_cast("date")).when(slashed != "", day_first.try_cast("date"))

    dated = requests.join(anchors, SERIES, "left").withColumn(DATE, resolved)
    return with_status(dated).drop("last_date", "latest", "before_latest")


def with_status(dated: DataFrame) -> DataFrame:
    """`days_ahead` and why a single-date request cannot be answered, if so."""
    ahead = F.datediff(DATE, "last_date")
    status = (
        F.when(F.col("last_date").isNull(), "unknown_series")
        .when(F.col(DATE).isNull(), "no_date")
        .when(ahead > MAX_HORIZON_DAYS, "too_far")
        .otherwise("ok")
    )
    return dated.withColumns({"days_ahead": ahead, "status": status})


def check_ranges(ranges: DataFrame) -> DataFrame:
    """Adds `range_days` and `status` to (start_date, end_date) rows: 1..365 days, end not before start."""
    days = F.datediff("end_date", "start_date") + 1
    status = (
        F.when(days.isNull(), "no_date")
        .when(days < 1, "end_before_start")
        .when(days > MAX_HORIZON_DAYS, "too_long")
        .otherwise("ok")
    )
    return ranges.withColumns({"range_days": days, "status": status})


def next_days(daily_last: DataFrame, days: Column | int) -> DataFrame:
    """The range of the next `days` days after each series' last day, with its status."""
    n = days if isinstance(days, Column) else F.lit(days)
    valid = n.between(1, MAX_HORIZON_DAYS)
    return daily_last.withColumns(
        {
            "start_date": F.when(valid, F.date_add("last_date", 1)),
            "end_date": F.when(valid, F.date_add(F.col("last_date"), n)),
            "status": F.when(valid, "ok").otherwise("bad_horizon"),
        }
    )
