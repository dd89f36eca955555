"""Calendar expressions over a date or timestamp column."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_int(c: Column) -> Column:
    return c.cast("int")


def day_of_week(c: Column) -> Column:
    """Monday is 0."""
    return F.weekday(c)


def is_weekend(c: Column) -> Column:
    return as_int(F.weekday(c) >= 5)


def season(c: Column) -> Column:
    """0 winter (Dec-Feb), 1 spring, 2 summer, 3 autumn."""
    return as_int(F.floor((F.month(c) % 12) / 3))


def day_metadata(c: Column) -> dict[str, Column]:
    return {
        "day_of_week": day_of_week(c),
        "is_weekend": is_weekend(c),
        "month": F.month(c),
        "season": season(c),
    }


def cycle(value: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a periodic value."""
    angle = F.lit(2 * math.pi) * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def epoch_micros(ts: Column) -> Column:
    """Microseconds of a TIMESTAMP_NTZ (the session zone must be UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def truncate(unit: str, ts: Column) -> Column:
    """`date_trunc` that stays TIMESTAMP_NTZ."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz")
