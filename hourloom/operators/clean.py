"""Gap filling and imputation.

Minute tables are processed in (series, day) chunks. What a chunk needs from outside - the nearest
readings before and after it, its row offset, the last few timestamps - comes from a table with one
row per chunk, so one series never has to fit in one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourloom.config import MEASURES, SERIES, TS, GapLimits
from hourloom.functions.calendar import epoch_micros
from hourloom.functions.stats import with_group_stats

_CHUNK = "_chunk"
_KEYS = [SERIES, _CHUNK]


def _placed():
    return F.col(TS).isNotNull() & F.col(SERIES).isNotNull()


def _chunked(readings: DataFrame) -> DataFrame:
    """Placed readings spread by (series, day), even if they arrive spread by series only."""
    dated = readings.where(_placed()).withColumns(
        {_CHUNK: F.to_date(TS), "_us": epoch_micros(F.col(TS)), "_tie": F.xxhash64(*readings.columns)}
    )
    # the join on the chunk would add this test to one of its sides only, and the shuffle would not be shared
    return dated.where(F.col(_CHUNK).isNotNull()).repartition(*_KEYS)


def _with_unplaced(filled: DataFrame, readings: DataFrame) -> DataFrame:
    """Readings without a time or a series have no neighbours; they come back as they are."""
    return filled.unionByName(readings.where(~_placed()).select(*filled.columns))


# What is remembered about a reading: row number, time in microseconds, value.
_PARTS = ("row", "us", "v")
# Repeated timestamps are ordered by a hash of the whole row, so the result does not depend on how rows arrive.
_IN_CHUNK = f"PARTITION BY {SERIES}, {_CHUNK} ORDER BY _us, _tie"
_IN_CHUNK_BACK = f"PARTITION BY {SERIES}, {_CHUNK} ORDER BY _us DESC, _tie DESC"
_IN_SERIES = f"PARTITION BY {SERIES} ORDER BY {_CHUNK}"


def _known(measure: str) -> dict[str, str]:
    """The parts of a reading where the measure is present, null elsewhere (SQL text)."""
    present = f"`{measure}` IS NOT NULL"
    return {"row": f"IF({present}, _row, NULL)", "us": f"IF({present}, _us, NULL)", "v": f"`{measure}`"}


def _nearest(measures: Sequence[str], prefix: str, over: str) -> list[str]:
    """Last present reading of each measure in the window."""
    window = f"OVER ({over} ROWS UNBOUNDED PRECEDING)"
    return [f"last({sql}, true) {window} AS `{prefix}_{part}_{m}`" for m in measures for part, sql in _known(m).items()]


def _chunk_edges(rows: DataFrame, measures: Sequence[str], hold: int) -> DataFrame:
    """Per chunk: its row offset, and the nearest readings and last `hold` times outside it."""
    aggregates = ["max(_row) AS _n", *[f"max_by({f'_us_{k}' if k else '_us'}, _row) AS _tail_{k}" for k in range(hold)]]
    for m in measures:
        known = _known(m)
        for name, end in (("first", "min"), ("last", "max")):
            aggregates += [f"{end}({known[part]}) AS `_{name}_{part}_{m}`" for part in ("row", "us")]
            aggregates.append(f"{end}_by(`{m}`, {known['row']}) AS `_{name}_v_{m}`")
    tail = f"array_compact(array({', '.join(f'_tail_{k}' for k in range(hold))}))" if hold else "CAST(array() AS array<bigint>)"
    edges = rows.groupBy(*_KEYS).agg(*map(F.expr, aggregates))
    edges = edges.selectExpr(
        *_KEYS,
        f"coalesce(sum(_n) OVER ({_IN_SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _offset",
        f"{tail} AS _tail",
        *[f"`_{name}_{part}_{m}`" for m in measures for name in ("first", "last") for part in _PARTS],
    )

    def outside(name: str, side: str, order: str) -> list[str]:
        """Nearest chunk before (or after) that has the measure, with rows counted from the series' start."""
        window = f"OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        return [
            f"last(`_{name}_{part}_{m}`{' + _offset' if part == 'row' else ''}, true) {window} AS `_{side}_{part}_{m}`"
            for m in measures
            for part in _PARTS
        ]

    times = f"collect_list(_tail) OVER ({_IN_SERIES} ROWS BETWEEN {max(hold, 1)} PRECEDING AND 1 PRECEDING)"
    return edges.selectExpr(
        *_KEYS,
        "_offset",
        f"flatten(reverse({times})) AS _tail",
        *outside("last", "before", _IN_SERIES),
        *outside("first", "after", f"{_IN_SERIES} DESC"),
    )


def interpolate_gaps(
    readings: DataFrame, measures: Sequence[str] = MEASURES, limits: GapLimits = GapLimits()
) -> DataFrame:
    """Bounded time interpolation, then a short hold, then a short back fill.

    In every run of nulls the first `interpolate` rows lie on the line between the surrounding
    readings (a trailing run holds its last reading), the next `hold` rows keep the last value of that
    line, and the final `back` rows take the next reading. The rest stays null. Between two readings of the
    same time the earlier one holds. Rows without a time or a series come back untouched.
    """
    other = [c for c in readings.columns if c not in (SERIES, TS, *measures)]
    kept = [f"`{c}`" for c in (*measures, *other)]
    hold = limits.hold

    # only the time in microseconds travels, so both readers of the chunks share one shuffle
    rows = _chunked(readings).selectExpr(
        SERIES,
        _CHUNK,
        "_us",
        "_tie",
        *kept,
        f"row_number() OVER ({_IN_CHUNK}) AS _row",
        *[f"lag(_us, {k}) OVER ({_IN_CHUNK}) AS _us_{k}" for k in range(1, hold + 1)],
    )
    edges = _chunk_edges(rows, measures, hold)
    near = rows.selectExpr("*", *_nearest(measures, "_prev", _IN_CHUNK), *_nearest(measures, "_next", _IN_CHUNK_BACK))

    def reached(inside: str, outside: str) -> list[str]:
        return [
            f"coalesce(`{inside}_{part}_{m}`{' + _offset' if part == 'row' else ''}, `{outside}_{part}_{m}`) AS `{inside}_{part}_{m}`"
            for m in measures
            for part in _PARTS
        ]

    linked = near.join(edges, _KEYS).selectExpr(
        SERIES,
        f"CAST(timestamp_micros(_us) AS timestamp_ntz) AS {TS}",
        "_us",
        *kept,
        "_row + _offset AS _row",
        "_tail",
        f"array({', '.join(f'_us_{k}' for k in range(1, hold + 1))}) AS _inside",
        f"least(_row - 1, {hold}) AS _n_inside",
        *reached("_prev", "_before"),
        *reached("_next", "_after"),
    )

    def filled(m: str) -> str:
        prev_row, prev_us, prev_v = (f"`_prev_{part}_{m}`" for part in _PARTS)
        next_row, next_us, next_v = (f"`_next_{part}_{m}`" for part in _PARTS)
        past_line = f"CAST(_row - {prev_row} - {limits.interpolate} AS int)"
        # rows past the line keep its last point, `past_line` rows up: in this chunk or before it
        above = f"IF({past_line} <= _n_inside, try_element_at(_inside, {past_line}), try_element_at(_tail, {past_line} - _n_inside))"
        at = f"IF({past_line} > 0, {above}, _us)"
        line = f"{prev_v} + try_divide({next_v} - {prev_v}, {next_us} - {prev_us}) * ({at} - {prev_us})"
        reach = f"_row - {prev_row} <= {limits.interpolate + hold}"
        if limits.max_gap is not None:
            reach += f" AND coalesce({next_row} - {prev_row} - 1, 0) <= {limits.max_gap}"
        return (
            f"CASE WHEN `{m}` IS NOT NULL THEN `{m}` WHEN {reach} THEN coalesce({line}, {prev_v}) "
            f"WHEN {next_row} - _row <= {limits.back} THEN {next_v} END AS `{m}`"
        )

    return _with_unplaced(linked.selectExpr(SERIES, TS, *[filled(m) for m in measures], *[f"`{c}`" for c in other]), readings)


def forward_fill(readings: DataFrame, measures: Sequence[str] = MEASURES) -> DataFrame:
    """Unbounded forward fill along time; rows without a time or a series come back untouched."""
    rows = _chunked(readings).drop("_us")
    newest = rows.groupBy(*_KEYS).agg(
        *[F.max(F.when(F.col(m).isNotNull(), F.struct(TS, "_tie", m)))[m].alias(f"_last_{m}") for m in measures]
    )
    earlier = Window.partitionBy(SERIES).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = newest.select(*_KEYS, *[F.last(f"_last_{m}", True).over(earlier).alias(f"_before_{m}") for m in measures])
    to_here = Window.partitionBy(*_KEYS).orderBy(TS, "_tie").rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumns({f"_prev_{m}": F.last(m, True).over(to_here) for m in measures})
    joined = near.join(carried, _KEYS)
    filled = joined.select(
        *[
            F.coalesce(F.col(f"_prev_{c}"), F.col(f"_before_{c}")).alias(c) if c in measures else F.col(c)
            for c in readings.columns
        ]
    )
    return _with_unplaced(filled, readings)


def drop_incomplete(readings: DataFrame, measures: Sequence[str] = MEASURES) -> DataFrame:
    """Only rows with every measure present."""
    return readings.na.drop("any", subset=list(measures))


def handle_missing(
    readings: DataFrame,
    method: str = "interpolate",
    measures: Sequence[str] = MEASURES,
    limits: GapLimits = GapLimits(),
) -> DataFrame:
    if method == "interpolate":
        return interpolate_gaps(readings, measures, limits)
    if method == "forward_fill":
        return forward_fill(readings, measures)
    if method == "drop":
        return drop_incomplete(readings, measures)
    raise ValueError(f"unknown fill method {method!r}")


def impute_mean(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Nulls become the column mean of their group."""
    means = with_group_stats(df, keys, {f"_mean_{c}": F.avg(c) for c in columns})
    filled = {c: F.coalesce(F.col(c), F.col(f"_mean_{c}")) for c in columns}
    return means.withColumns(filled).drop(*[f"_mean_{c}" for c in columns])


def impute_mode(
    df: DataFrame, column: str, keys: Sequence[str] = (SERIES,), fallback: int | None = None
) -> DataFrame:
    """Nulls become the most frequent value of their group (smallest on ties)."""
    most_frequent = F.mode(column, True).over(Window.partitionBy(*keys))
    choices = [F.col(column), most_frequent] + ([F.lit(fallback)] if fallback is not None else [])
    return df.withColumn(column, F.coalesce(*choices))


def zero_fill(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Every listed column exists afterwards, with 0 where it was absent or null."""
    present = set(df.columns)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) if c in present else F.lit(0.0) for c in columns})


def drop_unusable(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Rows that have the target and every feature."""
    return df.na.drop("any", subset=[target, *features])
