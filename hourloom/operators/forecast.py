"""Recursive day-by-day forecasts with a widening interval.

Each series is reduced to one state row (its last 30 values and a few means) with DataFrame operations.
The recursion then runs over batches of state rows: one step predicts the next day of every series in
the batch at once, so work is spread over tasks by series and nothing is grouped in Python.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourloom.config import (
    ANOMALY_FLAGS,
    DATE,
    INTERVAL_Z,
    MAX_HORIZON_DAYS,
    REFERENCE_SIGMA,
    SERIES,
    SUM_MEASURES,
    TARGET,
)
from hourloom.functions.calendar import day_of_week, is_weekend, season
from hourloom.functions.stats import most_frequent
from hourloom.functions.vectors import ordered_values
from hourloom.operators.features import LAGS
from hourloom.operators.model import contributions, predict
from hourloom.session import work_path

HISTORY = 30
# The longest lag: a series with fewer known days has no complete inputs.
SHORTEST_HISTORY = max(LAGS)


# ---------------------------------------------------------------- history statistics


def history_stats(daily: DataFrame, target: str = TARGET) -> DataFrame:
    """Mean target by weekday, by cluster and overall, long form (`kind`, `key`)."""
    sets = [[F.col(SERIES), F.col("day_of_week")], [F.col(SERIES)]]
    keys = [SERIES, "day_of_week"]
    if "cluster" in daily.columns:
        sets.append([F.col(SERIES), F.col("cluster")])
        keys.append("cluster")
    means = daily.groupingSets(sets, *keys).agg(F.avg(target).alias("mean"), F.grouping("day_of_week").alias("_no_dow"))
    if "cluster" not in daily.columns:
        means = means.withColumn("cluster", F.lit(None).cast("int"))
    kind = F.when(F.col("_no_dow") == 0, "weekday").when(F.col("cluster").isNotNull(), "cluster").otherwise("overall")
    return means.select(SERIES, kind.alias("kind"), F.coalesce("day_of_week", "cluster").alias("key"), "mean")


def season_cluster_rule(date: Column) -> Column:
    """Fixed rule: 1 in summer, otherwise 2 on weekends and 0 on weekdays."""
    return F.when(season(date) == 2, 1).when(is_weekend(date) == 1, 2).otherwise(0)


def learned_cluster_rule(daily: DataFrame) -> DataFrame:
    """Most frequent cluster per series, season and weekend flag."""
    return most_frequent(daily, [SERIES, "season", "is_weekend"], "cluster", "expected_cluster")


def with_interval(forecast: DataFrame, sigma: Column | float = REFERENCE_SIGMA, days_ahead: str = "days_ahead") -> DataFrame:
    """Uncertainty sigma * sqrt(days ahead) and the 95 % interval, never below zero."""
    spread = (sigma if isinstance(sigma, Column) else F.lit(float(sigma))) * F.sqrt(F.col(days_ahead))
    return forecast.withColumns(
        {
            "uncertainty": spread,
            "ci_lower": F.greatest(F.lit(0.0), F.col("prediction") - INTERVAL_Z * spread),
            "ci_upper": F.col("prediction") + INTERVAL_Z * spread,
        }
    )


# ---------------------------------------------------------------- state of a series


def last_dates(daily: DataFrame) -> DataFrame:
    """Last day of each series in the unfiltered daily table."""
    return daily.groupBy(SERIES).agg(F.max(DATE).alias("last_date"))


def forecast_states(clean: DataFrame, daily: DataFrame, sigma: DataFrame | None = None, target: str = TARGET) -> DataFrame:
    """One row per series: what a forecast needs to know about its history.

    `clean` supplies the values (with `cluster` if known), `daily` the last day; `sigma` (series_id,
    sigma) overrides the default spread.
    """
    recent = Window.partitionBy(SERIES).orderBy(F.desc(DATE))
    tail = (
        clean.withColumn("_back", F.row_number().over(recent))
        .where(F.col("_back") <= HISTORY)
        .groupBy(SERIES)
        .agg(
            ordered_values(F.col(DATE), F.col(target)).alias("recent"),
            *(
                [F.avg(F.when(F.col("_back") <= 7, F.col("Voltage_mean"))).alias("voltage")]
                if "Voltage_mean" in clean.columns
                else []
            ),
            *([F.max_by("cluster", DATE).alias("last_cluster")] if "cluster" in clean.columns else []),
        )
    )
    metering = [f"{m}_sum" for m in SUM_MEASURES if f"{m}_sum" in clean.columns]
    states = clean.groupBy(SERIES).agg(
        F.min(DATE).alias("first_date"),
        F.avg(target).alias("overall_avg"),
        *[F.avg(F.when(day_of_week(F.col(DATE)) == d, F.col(target))).alias(f"dow_{d}") for d in range(7)],
        *[F.avg(m).alias(f"mean_{m}") for m in metering],
    )
    states = states.join(tail, SERIES).join(last_dates(daily), SERIES)
    if "cluster" in clean.columns:
        per_cluster = clean.groupBy(SERIES, "cluster").agg(F.avg(target).alias("_mean"))
        cluster_avg = per_cluster.groupBy(SERIES).agg(
            F.map_from_entries(F.collect_list(F.struct("cluster", "_mean"))).alias("cluster_avg")
        )
        dated = clean.withColumns({"season": season(F.col(DATE)), "is_weekend": is_weekend(F.col(DATE))})
        rule = learned_cluster_rule(dated).groupBy(SERIES).agg(
            F.map_from_entries(
                F.collect_list(F.struct((F.col("season") * 2 + F.col("is_weekend")).alias("k"), F.col("expected_cluster")))
            ).alias("cluster_rule")
        )
        states = states.join(cluster_avg, SERIES, "left").join(rule, SERIES, "left")
    if sigma is not None:
        states = states.join(sigma.select(SERIES, "sigma"), SERIES, "left")
    else:
        states = states.withColumn("sigma", F.lit(None).cast("double"))
    return states.withColumn("sigma", F.coalesce("sigma", F.lit(REFERENCE_SIGMA)))


# ---------------------------------------------------------------- the forest as arrays


@dataclass(frozen=True)
class ForestArrays:
    """Trees padded to one width; a leaf points to itself. Size is set by the model, not the data."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    weight: np.ndarray
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.value))[:, None]
        rows = np.arange(len(x))[None, :]
        node = np.zeros((len(self.value), len(x)), dtype=np.int32)
        for _ in range(self.depth):
            goes_left = x[rows, self.feature[trees, node]] <= self.threshold[trees, node]
            node = np.where(goes_left, self.left[trees, node], self.right[trees, node])
        return self.weight @ self.value[trees, node]


def forest_arrays(spark: SparkSession, model: PipelineModel) -> ForestArrays:
    """Read the fitted trees from the model's saved node table."""
    regressor = model.stages[-1]
    path = work_path(spark, "forest")
    regressor.write().save(path)
    nodes = (
        spark.read.parquet(f"{path}/data")
        .select(
            F.col("treeID").alias("tree"),
            "nodeData.id",
            "nodeData.prediction",
            "nodeData.leftChild",
            "nodeData.rightChild",
            F.col("nodeData.split.featureIndex").alias("feature"),
            F.get("nodeData.split.leftCategoriesOrThreshold", 0).alias("threshold"),
        )
        .toPandas()
    )
    shape = (int(nodes["tree"].max()) + 1, int(nodes["id"].max()) + 1)
    at = (nodes["tree"].to_numpy(), nodes["id"].to_numpy())
    inner = nodes["leftChild"].to_numpy() >= 0

    def table(values, dtype) -> np.ndarray:
        out = np.zeros(shape, dtype=dtype)
        out[at] = values
        return out

    weight = np.array(regressor.treeWeights, dtype=float)
    if isinstance(regressor, RandomForestRegressionModel):
        weight = weight / weight.sum()
    return ForestArrays(
        table(np.where(inner, nodes["feature"], 0), np.int32),
        table(np.where(inner, nodes["threshold"], 0.0), float),
        table(np.where(inner, nodes["leftChild"], nodes["id"]), np.int32),
        table(np.where(inner, nodes["rightChild"], nodes["id"]), np.int32),
        table(nodes["prediction"], float),
        weight,
        max(tree.depth for tree in regressor.trees),
    )


# ---------------------------------------------------------------- recursion


def _tail_stat(history: np.ndarray, rows: int, stat) -> np.ndarray:
    with np.errstate(all="ignore"):
        return stat(np.ma.masked_invalid(history[:, -rows:]), axis=1).filled(np.nan)


def _std(values, axis):
    return values.std(axis=axis, ddof=1)


def _dense(maps: pd.Series, width: int) -> np.ndarray:
    """Integer-keyed maps as rows of a matrix, NaN where a key is absent."""
    out = np.full((len(maps), width), np.nan)
    for i, entries in enumerate(maps):
        for key, value in dict(entries or {}).items():
            if 0 <= key < width:
                out[i, int(key)] = value
    return out


def _pick(table: np.ndarray, keys: np.ndarray, default: np.ndarray) -> np.ndarray:
    found = table[np.arange(len(keys)), np.clip(keys.astype(int), 0, table.shape[1] - 1)]
    return np.where(np.isnan(found), default, found)


def _step_features(
    states: pd.DataFrame, lookups: dict, history: np.ndarray, dates: pd.DatetimeIndex, yesterday: np.ndarray
) -> dict:
    """Feature name -> values for the day after `history`, matching the training definitions."""
    dow, month = dates.dayofweek.to_numpy(), dates.month.to_numpy()
    weekend, season_no = (dow >= 5).astype(int), month % 12 // 3
    overall = states["overall_avg"].to_numpy(dtype=float)
    features = {
        "day_of_week": dow,
        "day_of_month": dates.day.to_numpy(),
        "month": month,
        "year": dates.year.to_numpy(),
        "quarter": dates.quarter.to_numpy(),
        "week_of_year": dates.isocalendar().week.to_numpy(dtype=float),
        "is_weekend": weekend,
        "is_month_start": dates.is_month_start.astype(int),
        "is_month_end": dates.is_month_end.astype(int),
        "season": season_no,
        "day_of_week_sin": np.sin(2 * np.pi * dow / 7),
        "day_of_week_cos": np.cos(2 * np.pi * dow / 7),
        "month_sin": np.sin(2 * np.pi * month / 12),
        "month_cos": np.cos(2 * np.pi * month / 12),
        **{f"lag_{k}d": history[:, -k] for k in LAGS},
        "same_day_last_week": history[:, -7],
        "rolling_7d_mean": _tail_stat(history, 7, np.ma.mean),
        "rolling_7d_std": _tail_stat(history, 7, _std),
        "rolling_7d_min": _tail_stat(history, 7, np.ma.min),
        "rolling_7d_max": _tail_stat(history, 7, np.ma.max),
        "last_2weeks_avg": _tail_stat(history, 14, np.ma.mean),
        "rolling_30d_mean": _tail_stat(history, 30, np.ma.mean),
        "rolling_30d_std": _tail_stat(history, 30, _std),
        "trend_7d": history[:, -1] - history[:, -8],
        "day_number": (dates - pd.DatetimeIndex(states["first_date"])).days.to_numpy(),
    }
    features["last_week_avg"] = features["rolling_7d_mean"]
    features["ratio_to_weekly_avg"] = history[:, -1] / (features["rolling_7d_mean"] + 1e-6)
    features["dow_typical_consumption"] = _pick(lookups["weekday"], dow, overall)
    if "rule" in lookups:
        cluster = _pick(lookups["rule"], season_no * 2 + weekend, yesterday)
        features["cluster"] = cluster
        features["cluster_avg_consumption"] = _pick(lookups["cluster_avg"], cluster, overall)
        features["yesterday_cluster"] = yesterday
    if "voltage" in states:
        features["voltage_avg"] = features["voltage_7d_avg"] = states["voltage"].to_numpy(dtype=float)
    for m in SUM_MEASURES:
        if f"mean_{m}_sum" in states:
            features[f"{m}_sum"] = states[f"mean_{m}_sum"].to_numpy(dtype=float)
    return features


def _known_inputs(columns: Sequence[str]) -> set[str]:
    """Inputs that the recursion can produce from state rows with these columns."""
    state = pd.DataFrame({c: [np.nan] for c in columns if c not in ("cluster_rule", "cluster_avg")})
    state["first_date"] = pd.Timestamp("2000-01-01")
    lookups = {"weekday": np.zeros((1, 7))}
    if "cluster_rule" in columns:
        lookups |= {"rule": np.zeros((1, 8)), "cluster_avg": np.zeros((1, 1))}
    day = pd.DatetimeIndex([pd.Timestamp("2000-02-01")])
    return set(_step_features(state, lookups, np.zeros((1, HISTORY)), day, np.zeros(1)))


def _lookups(states: pd.DataFrame) -> dict[str, np.ndarray]:
    tables = {"weekday": states[[f"dow_{d}" for d in range(7)]].to_numpy(dtype=float)}
    if "cluster_rule" in states:
        clusters = 1 + max((int(k) for m in states["cluster_avg"] for k in dict(m or {})), default=0)
        tables["rule"] = _dense(states["cluster_rule"], 8)
        tables["cluster_avg"] = _dense(states["cluster_avg"], clusters)
    return tables


def recursive_forecast(states: DataFrame, forest: ForestArrays, features: Sequence[str]) -> DataFrame:
    """Daily forecasts from the day after `last_date`, for `horizon` days of each state row.

    Every prediction is floored at zero and joins the history once. The anomaly flags of a future day are zero; any
    other input that the recursion cannot produce is an error. Series with fewer than `SHORTEST_HISTORY` known days
    and horizons outside 1 to 365 have no rows; `forecast_status` names them.
    """
    unknown = set(features) - _known_inputs(states.columns) - {*ANOMALY_FLAGS, "anomaly_count", "is_anomaly"}
    if unknown:
        raise ValueError(f"a forecast cannot produce the inputs {sorted(unknown)}; build the states from the labelled table")
    # plain arrays: broadcast values are unpickled where this package may not be installed
    shared = states.sparkSession.sparkContext.broadcast(tuple(vars(forest).values()))
    names = list(features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = ForestArrays(*shared.value)
        for batch in batches:
            if batch.empty:
                continue
            batch = batch.reset_index(drop=True)
            history = np.full((len(batch), HISTORY), np.nan)
            for i, values in enumerate(batch["recent"]):
                if len(values):
                    history[i, -len(values) :] = values
            last = pd.DatetimeIndex(batch["last_date"])
            horizon = batch["horizon"].to_numpy()
            lookups = _lookups(batch)
            yesterday = (
                batch["last_cluster"].fillna(0).to_numpy(dtype=float) if "last_cluster" in batch else np.zeros(len(batch))
            )
            for step in range(1, int(horizon.max()) + 1):
                live = horizon >= step
                if not live.all():
                    batch, last, horizon = batch[live].reset_index(drop=True), last[live], horizon[live]
                    history, yesterday = history[live], yesterday[live]
                    lookups = {name: rows[live] for name, rows in lookups.items()}
                dates = last + pd.Timedelta(days=step)
                known = _step_features(batch, lookups, history, dates, yesterday)
                columns = [np.asarray(known.get(n, np.zeros(len(batch))), dtype=float) for n in names]
                x = np.nan_to_num(np.column_stack(columns), nan=0.0)
                predicted = np.maximum(0.0, trees.predict(x))
                history = np.column_stack([history[:, 1:], predicted])
                yesterday = np.asarray(known.get("cluster", yesterday), dtype=float)
                yield pd.DataFrame(
                    {
                        SERIES: batch[SERIES],
                        DATE: dates.date,
                        "days_ahead": np.int32(step),
                        "prediction": predicted,
                        "_sigma": batch["sigma"],
                    }
                )

    schema = f"{SERIES} string, {DATE} date, days_ahead int, prediction double, _sigma double"
    runnable = states.where(F.col("horizon").between(1, MAX_HORIZON_DAYS) & (F.size("recent") >= SHORTEST_HISTORY))
    # state rows are tiny, but each is a long computation
    rows = runnable.repartition(2 * states.sparkSession.sparkContext.defaultParallelism, SERIES).mapInPandas(run, schema)
    return with_interval(rows, F.col("_sigma")).drop("_sigma").withColumn("method", F.lit("recursive_rf"))


def forecast_ahead(states: DataFrame, forest: ForestArrays, features: Sequence[str], days: int) -> DataFrame:
    """The next `days` days of every series."""
    if not 1 <= days <= MAX_HORIZON_DAYS:
        raise ValueError(f"horizon must be 1..{MAX_HORIZON_DAYS} days, got {days}")
    return recursive_forecast(states.withColumn("horizon", F.lit(days)), forest, features)


def forecast_status(days_ahead: Column, known_days: Column) -> Column:
    """Why a day can or cannot be forecast."""
    return (
        F.when(known_days.isNull(), "unknown_series")
        .when(days_ahead.isNull(), "no_date")
        .when(days_ahead > MAX_HORIZON_DAYS, "too_far")
        .when(known_days < SHORTEST_HISTORY, "short_history")
        .otherwise("ok")
    )


def check_forecast_ranges(states: DataFrame, ranges: DataFrame) -> DataFrame:
    """The ranges with `status`: ok, unknown_series, no_date, empty_range, in_the_past, too_far or short_history."""
    known = states.select(SERIES, "last_date", F.size("recent").alias("_known"))
    dated = ranges.join(known, SERIES, "left")
    ahead = F.datediff("end_date", "last_date")
    reason = forecast_status(ahead, F.col("_known"))
    status = (
        F.when(reason == "ok", F.when(F.col("start_date").isNull(), "no_date").when(F.col("start_date") > F.col("end_date"), "empty_range").when(ahead < 1, "in_the_past"))
    )
    return dated.withColumn("status", F.coalesce(status, reason)).drop("_known", "last_date")


def forecast_ranges(states: DataFrame, forest: ForestArrays, features: Sequence[str], ranges: DataFrame) -> DataFrame:
    """Forecast rows inside requested (series_id, start_date, end_date) ranges that `check_forecast_ranges` accepts.

    Every range is judged by itself. A series is simulated once, to the furthest accepted end, and its days meet the
    ranges on series and date.
    """
    accepted = check_forecast_ranges(states, ranges).where(F.col("status") == "ok").drop("status")
    until = accepted.groupBy(SERIES).agg(F.max("end_date").alias("_until"))
    horizons = states.join(until, SERIES).withColumn("horizon", F.datediff("_until", "last_date")).drop("_until")
    days = recursive_forecast(horizons, forest, features)
    wanted = accepted.withColumn(DATE, F.explode(F.sequence("start_date", "end_date")))
    return days.join(wanted, [SERIES, DATE])


def answer_requests(
    requests: DataFrame,
    features_table: DataFrame,
    states: DataFrame,
    model: PipelineModel,
    forest: ForestArrays,
    features: Sequence[str],
    importances: dict[str, float],
    daily: DataFrame | None = None,
) -> DataFrame:
    """One prediction record per (request_id, series_id, date) request, with a `status` and the last known day.

    Dates up to the last known day are scored by the model and compared with the actual; later ones are
    forecast recursively. A request without an answer keeps a null prediction and says why: unknown_series, no_date,
    too_far, short_history, or for a past day not_scored - removed_day where `daily` (all days with `is_anomaly`)
    shows that it was taken out as anomalous.
    """
    known = states.select(SERIES, "last_date", F.size("recent").alias("_known"))
    dated = requests.join(known, SERIES, "left").withColumn("days_ahead", F.greatest(F.datediff(DATE, "last_date"), F.lit(0)))
    dated = dated.withColumn("days_ahead", F.when(F.col(DATE).isNotNull() & F.col("last_date").isNotNull(), F.col("days_ahead")))
    past = dated.where(F.coalesce("days_ahead", F.lit(0)) == 0)
    asked = features_table.join(past.select(SERIES, DATE).distinct(), [SERIES, DATE], "left_semi")
    scored = predict(model, asked, features).select(
        SERIES,
        DATE,
        "prediction",
        F.col(TARGET).alias("actual"),
        F.abs(F.col("prediction") - F.col(TARGET)).alias("error"),
        contributions(importances).alias("top_features"),
        F.lit("random_forest").alias("method"),
    )
    history = past.join(scored, [SERIES, DATE], "left")
    if daily is not None:
        removed = daily.where("is_anomaly").select(SERIES, DATE, F.lit(True).alias("_removed"))
        history = history.join(removed, [SERIES, DATE], "left")
    else:
        history = history.withColumn("_removed", F.lit(False))

    future = dated.where(F.col("days_ahead") > 0)
    reachable = future.where(F.col("days_ahead") <= MAX_HORIZON_DAYS)
    horizon = reachable.groupBy(SERIES).agg(F.max("days_ahead").alias("horizon"))
    ahead = recursive_forecast(states.join(horizon, SERIES), forest, features).drop("days_ahead")
    answered = future.join(ahead, [SERIES, DATE], "left")
    every = history.unionByName(answered, allowMissingColumns=True)
    missing = F.when(F.col("_removed"), "removed_day").otherwise("not_scored")
    reason = forecast_status(F.col("days_ahead"), F.when(F.col("last_date").isNotNull(), F.greatest("_known", F.when(F.col("days_ahead") == 0, SHORTEST_HISTORY))))
    status = F.when(F.col("prediction").isNotNull(), "ok").when((reason == "ok") & (F.col("days_ahead") == 0), missing).otherwise(reason)
    # a past day is not "ahead" of anything
    ahead = F.when(F.col("days_ahead") > 0, F.col("days_ahead"))
    return (
        every.withColumns({"status": status, "days_ahead": ahead, "day_of_week": F.date_format(DATE, "EEEE")}).drop("_known", "_removed")
    )


def range_summary(forecast: DataFrame, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Mean, smallest, largest and total prediction."""
    return forecast.groupBy(*keys).agg(
        F.avg("prediction").alias("average"),
        F.min("prediction").alias("minimum"),
        F.max("prediction").alias("maximum"),
        F.sum("prediction").alias("total"),
    )
