"""Registry of queries and the helpers that make both sides print alike."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


@dataclass(frozen=True)
class Query:
    name: str
    item: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, item: str, sql: str | None = None):
    """Register a query under `name` for the inventory item(s) `item`."""

    def add(run: Callable[[SparkSession, str], DataFrame]):
        if name in CATALOG:
            raise ValueError(f"duplicate query {name}")
        CATALOG[name] = Query(name, item, lambda spark, sf_dir: printable(run(spark, sf_dir)), sql)
        return run

    return add


def printable(df: DataFrame) -> DataFrame:
    """Doubles rounded, dates and timestamps as text."""
    columns = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, T.DoubleType):
            c = F.round(c, DIGITS)
        elif isinstance(field.dataType, (T.DateType, T.TimestampNTZType, T.TimestampType)):
            c = c.cast("string")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def cols(spec: str) -> str:
    """SQL select list from `name:kind` words: r rounded, s text, i INTEGER, l BIGINT, none as is."""
    kinds = {
        "r": f"round({{0}}, {DIGITS}) AS {{0}}",
        "s": "CAST({0} AS VARCHAR) AS {0}",
        "i": "CAST({0} AS INTEGER) AS {0}",
        "l": "CAST({0} AS BIGINT) AS {0}",
        "": "{0}",
    }
    words = [w.partition(":") for w in spec.split()]
    return ", ".join(kinds[kind].format(name) for name, _, kind in words)


def sql_with(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes) + "\n" + select.strip()
