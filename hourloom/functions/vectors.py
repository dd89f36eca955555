"""Expressions over fixed-length ARRAY<DOUBLE> columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def ordered_values(position: Column, value: Column) -> Column:
    """Aggregate: values of a small group as an array ordered by position."""
    return F.transform(F.array_sort(F.collect_list(F.struct(position.alias("p"), value.alias("v")))), lambda s: s["v"])


def slots(values: Column, names: Sequence[str]) -> list[Column]:
    """One column per array slot."""
    return [values[i].alias(name) for i, name in enumerate(names)]
