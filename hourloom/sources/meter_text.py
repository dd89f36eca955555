"""Delimited meter files: `;` separated, header, day-first dates, `?` or empty for missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.config import MEASURES, SERIES, TS

TEXT_SCHEMA = T.StructType(
    [T.StructField("Date", T.StringType()), T.StructField("Time", T.StringType())]
    + [T.StructField(m, T.StringType()) for m in MEASURES]
)
CSV_OPTIONS = {"sep": ";", "nullValue": "?", "mode": "PERMISSIVE"}


def _timestamp(date: Column, time: Column) -> Column:
    """Day-first date plus time of day; anything else is null."""
    iso = F.regexp_replace(date, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$2-$1")
    text = F.concat(iso, F.lit(" "), time)
    shaped = text.rlike(r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$")
    return F.when(shaped, text).try_cast("timestamp_ntz")


def _measure(name: str) -> Column:
    value = F.col(name).try_cast("double")
    return F.when(~F.isnan(value), value).alias(name)


def parse_meter_fields(fields: DataFrame, series: Column) -> DataFrame:
    """Typed readings from the string fields of `TEXT_SCHEMA`; bad dates and numbers become null."""
    return fields.select(
        series.alias(SERIES),
        _timestamp(F.col("Date"), F.col("Time")).alias(TS),
        *[_measure(m) for m in MEASURES],
    )


def parse_meter_lines(lines: DataFrame, line: str, series: Column) -> DataFrame:
    """Typed readings from a column of raw text lines."""
    row = F.from_csv(F.col(line), TEXT_SCHEMA.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), CSV_OPTIONS)
    fields = lines.select("*", row.alias("_row")).select("*", "_row.*")
    return parse_meter_fields(fields, series)


def read_meter_text(spark: SparkSession, path: str | list[str], series: Column | None = None) -> DataFrame:
    """Read meter files by the names in their header; without `series` the file name (no extension) is the series id.

    The files of one call share one column order; a file with another one is an error, not a misreading.
    """
    raw = spark.read.options(header=True, enforceSchema=False, **CSV_OPTIONS).csv(path)
    if series is None:
        series = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return parse_meter_fields(raw, series)


def load_report(readings: DataFrame, measures: Sequence[str] = MEASURES) -> DataFrame:
    """Rows, time span and missing cells per series."""
    missing = sum((F.sum(F.col(m).isNull().cast("bigint")) for m in measures), F.lit(0).cast("bigint"))
    return readings.groupBy(SERIES).agg(
        F.count("*").alias("n_rows"),
        F.min(TS).alias("first_ts"),
        F.max(TS).alias("last_ts"),
        missing.alias("missing_values"),
    )
