"""Grouped statistics beside their rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_group_stats(df: DataFrame, keys: Sequence[str], stats: Mapping[str, Column]) -> DataFrame:
    """Adds aggregates of each row's group, in one pass over `df`.

    For tables whose groups are bounded by the calendar (daily rows of a series): computing the table
    twice for a join would read the raw data twice, while its own rows are few.
    """
    group = Window.partitionBy(*keys)
    return df.withColumns({name: c.over(group) for name, c in stats.items()})


def most_frequent(df: DataFrame, keys: Sequence[str], value: str, alias: str) -> DataFrame:
    """Most frequent non-null value per group; ties go to the smallest value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(
        F.min_by(F.col(value), F.struct(-F.col("_n"), F.col(value))).alias(alias)
    )
