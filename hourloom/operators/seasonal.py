"""Weekly seasonal ARIMA for fleets of daily series.

A series travels as one row holding its value for every date from its first to its last, null where a date is
missing, so that seven values are a week. The order grid multiplies rows; fits of one order that arrive in a
batch run together as (time, series, candidate) arrays. A fit of (p,d,q)x(1,0,1,7) starts at the least squared
one-step errors (conditional on the first rows, missing dates taking the value of the week before) and from there
climbs the exact likelihood of the known days (see `seasonal_likelihood`); undifferenced orders have a mean. All orders
are judged on the same days, all known ones but the first.

Every series has a row in what this module returns: one that has no model keeps the reason.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourloom.config import DATE, SERIES, TARGET, SeasonalConfig
from hourloom.functions.vectors import ordered_values
from hourloom.operators.features import on_every_date
from hourloom.operators.model import regression_metrics, time_split
from hourloom.operators.seasonal_likelihood import Filtered, Lanes, forecast_paths, kalman
from hourloom.session import materialize

# Series that are fitted as one set of arrays.
TOGETHER = 64
# Orders of a series that climb the exact likelihood, and in how many steps at most.
REFINED = 3
EXACT_ROUNDS = 4

FIT_SCHEMA = (
    "aic double, loglik double, known_days int, sigma double, intercept double, mean double, "
    "ar array<double>, ma array<double>, state array<double>, reason string"
)
FIT_NAMES = ["aic", "loglik", "known_days", "sigma", "intercept", "mean", "ar", "ma", "state", "reason"]


def series_rows(daily: DataFrame, target: str = TARGET) -> DataFrame:
    """One row per series: its values on every date between its first and last known one, and that last date."""
    known = daily.where(F.col(target).isNotNull()).select(SERIES, DATE, target)
    return on_every_date(known).groupBy(SERIES).agg(ordered_values(F.col(DATE), F.col(target)).alias("y"), F.max(DATE).alias("last_date"))


def _filled(values: Sequence[float | None], period: int) -> tuple[np.ndarray, np.ndarray]:
    """Values without holes (one period earlier, else on the line between neighbours), and which of them are known."""
    y = np.array([np.nan if v is None else v for v in values], dtype=float)
    known = ~np.isnan(y)
    line = np.interp(np.arange(len(y)), np.flatnonzero(known), y[known]) if known.any() else np.zeros(len(y))
    for t in np.flatnonzero(~known):
        y[t] = y[t - period] if t >= period else line[t]
    return y, known


def _coefficients(params: np.ndarray, p: int, q: int, period: int) -> tuple[list[int], np.ndarray, list[int], np.ndarray]:
    """Lags and weights (..., lag) of w and of the shocks, from (ar, seasonal ar, ma, seasonal ma)."""
    short, seasonal = params[..., :p], params[..., p : p + 1]
    ma, seasonal_ma = params[..., p + 1 : p + 1 + q], params[..., p + 1 + q : p + 2 + q]
    ar_lags = [*range(1, p + 1), *range(period, period + p + 1)]
    ma_lags = [*range(1, q + 1), *range(period, period + q + 1)]
    return ar_lags, np.concatenate([short, seasonal, -short * seasonal], -1), ma_lags, np.concatenate([ma, seasonal_ma, ma * seasonal_ma], -1)


def _shocks(w: np.ndarray, scored: np.ndarray, candidates: np.ndarray, p: int, q: int, period: int) -> np.ndarray:
    """One-step errors (time, series, candidate); zero where a step is not scored."""
    ar_lags, ar, ma_lags, ma = _coefficients(candidates, p, q, period)
    centred = w[:, :, None] - candidates[None, :, :, -1]
    start, steps = p + period, len(w)
    errors = np.zeros_like(centred)
    errors[start:] = centred[start:]
    for i, k in enumerate(ar_lags):
        errors[start:] -= ar[None, :, :, i] * centred[start - k : steps - k]
    weights, lags, seen = np.moveaxis(ma, -1, 0), np.array(ma_lags), scored[:, :, None]
    with np.errstate(over="ignore", invalid="ignore"):
        errors *= seen
        for t in range(period + q, steps):
            errors[t] -= (weights * errors[t - lags]).sum(axis=0) * seen[t]
    return errors


def _explosive(params: np.ndarray, p: int) -> bool:
    return bool(abs(params[p]) > 1.0 or np.abs(np.roots([1.0, *-params[:p]])).max(initial=0.0) > 1.0)


def _descend(residuals, params: np.ndarray, free: int, scale: np.ndarray, p: int, rounds: int) -> np.ndarray:
    """Damped least squares from `params` (series, parameter), all series side by side; gives the sums that are left.

    `residuals(at, candidates)` gives (time, series, candidate) for the series `at`; `params` is changed in place.
    """

    def cost(errors: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            return np.nan_to_num((errors**2).sum(axis=0), nan=np.inf)

    everyone = np.arange(len(params))
    errors = residuals(everyone, params[:, None, :])[:, :, 0]
    best, live = cost(errors), np.ones(len(params), bool)
    for _ in range(rounds):
        at = np.flatnonzero(live & np.isfinite(best))
        if not len(at):
            break
        nudges = np.eye(params.shape[1])[:free] * scale[at][:, None, :] * 1e-5
        slopes = (residuals(at, params[at][:, None, :] + nudges) - errors[:, at, None]) / (scale[at][:, :free] * 1e-5)
        slopes = np.nan_to_num(slopes, nan=0.0, posinf=0.0, neginf=0.0)
        normal = np.einsum("tsf,tsg->sfg", slopes, slopes)
        pull = np.einsum("tsf,ts->sf", slopes, errors[:, at])
        trials = np.repeat(params[at][:, None, :], 4, axis=1)
        ridge = np.einsum("sff->sf", normal) + 1e-9
        for k, damping in enumerate((1e-6, 1e-2, 1.0, 100.0)):
            trials[:, k, :free] -= np.linalg.solve(normal + damping * ridge[:, :, None] * np.eye(free), pull[:, :, None])[:, :, 0]
        tried = residuals(at, trials)
        barred = np.array([[_explosive(t, p) for t in row] for row in trials])
        costs = np.where(barred, np.inf, cost(tried))
        winner = costs.argmin(axis=1)
        better = costs[np.arange(len(at)), winner] < best[at] * (1 - 1e-5)
        moved = at[better]
        params[moved] = trials[better, winner[better]]
        errors[:, moved] = tried[:, better, winner[better]]
        best[moved] = costs[better, winner[better]]
        live[at[~better]] = False
    return best


def _stationary(params: np.ndarray, p: int, least: float = 0.995) -> None:
    """Pull parameters (series, parameter) inside the region that has an exact likelihood, in place."""
    params[:, p] = np.clip(params[:, p], -least, least)
    for row in params:
        reach = np.abs(np.roots([1.0, *-row[:p]])).max(initial=0.0)
        if reach > least:
            row[:p] *= (least / reach) ** np.arange(1, p + 1)


def _by_lag(params: np.ndarray, p: int, q: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    """(lag, lane) weights for `params` (lane, parameter)."""
    ar_lags, ar, ma_lags, ma = _coefficients(params, p, q, period)
    dense = np.zeros((p + period, len(params))), np.zeros((q + period, len(params)))
    np.add.at(dense[0], np.array(ar_lags) - 1, ar.T)
    np.add.at(dense[1], np.array(ma_lags) - 1, ma.T)
    return dense


class Exact:
    """Known days of several series, from the first known one on, ready to be filtered under any parameters."""

    def __init__(self, series: Sequence[Sequence[float | None]], d: int):
        self.d = d
        known = [np.array([np.nan if v is None else v for v in values], dtype=float) for values in series]
        known = [y[np.flatnonzero(~np.isnan(y))[0] :] for y in known]
        self.lengths = np.array([len(y) for y in known])
        self.y = np.full((self.lengths.max(), len(known)), np.nan)
        for k, y in enumerate(known):
            self.y[: len(y), k] = y
        # A differenced series is filtered from its first value on, for the sake of small numbers.
        self.level = self.y[0] if d else np.zeros(len(known))

    def filtered(self, at: np.ndarray, candidates: np.ndarray, p: int, q: int, period: int) -> Filtered:
        """Lanes (series, candidate) in that order."""
        count = candidates.shape[1]
        flat = candidates.reshape(-1, candidates.shape[2])
        centre = np.repeat(self.level[at], count) if self.d else flat[:, -1]
        y = np.repeat(self.y[:, at], count, axis=1) - centre
        return kalman(y, np.repeat(self.lengths[at], count), Lanes(*_by_lag(flat, p, q, period), self.d))


def _fit_together(series: list, p: int, d: int, q: int, period: int, common: int, rounds: int = 15, exact_rounds: int = EXACT_ROUNDS) -> list[dict]:
    """Fits of many series: least squares from afar, then the exact likelihood."""
    out: list[dict] = [{"reason": "too short"} for _ in series]
    free = p + q + 2 + (0 if d else 1)
    own, ready = [], []
    for i, values in enumerate(series):
        w, known = _filled(values, period)
        for _ in range(d):
            w, known = np.diff(w), known[1:] & known[:-1]
        if len(w) >= common + 2 * period + 2 * free and known[common - d :].sum() > 2 * free:
            own.append(i)
            ready.append((w, known))
    if not own:
        return out
    steps = period + q + max(len(w) for w, _ in ready)  # a margin, so that every lag has a row
    values, scored, counted = np.zeros((steps, len(own))), np.zeros((steps, len(own)), bool), np.zeros((steps, len(own)), bool)
    for k, (w, known) in enumerate(ready):
        low = steps - len(w)
        values[low:, k] = w
        scored[low + p + period :, k] = known[p + period :]
        counted[low + common - d :, k] = known[common - d :]
    counted &= scored
    params = np.tile([*[0.1] * p, 0.9, *[-0.1] * q, -0.7, 0.0], (len(own), 1))
    params[:, -1] = [w.mean() if d == 0 else 0.0 for w, _ in ready]
    scale = np.ones_like(params)
    scale[:, -1] = [max(float(w.std()), 1e-6) for w, _ in ready]
    _descend(lambda at, tried: _shocks(values[:, at], scored[:, at], tried, p, q, period) * counted[:, at, None], params, free, scale, p, rounds)
    _stationary(params, p)
    exact = Exact([series[i] for i in own], d)

    def residuals(at: np.ndarray, tried: np.ndarray) -> np.ndarray:
        return exact.filtered(at, tried, p, q, period).residuals().reshape(-1, len(at), tried.shape[1])

    _descend(residuals, params, free, scale, p, exact_rounds)
    found = exact.filtered(np.arange(len(own)), params[:, None, :], p, q, period)
    loglik, variance = found.log_likelihood()
    ar, ma = _by_lag(params, p, q, period)
    for k, i in enumerate(own):
        if not np.isfinite(loglik[k]):
            out[i] = {"reason": "no likelihood"}
            continue
        state = found.state[:, k].copy()
        state[0] += exact.level[k] if d else 0.0
        out[i] = {
            "aic": float(2 * (free + 1) - 2 * loglik[k]),
            "loglik": float(loglik[k]),
            "known_days": int(found.counted()[:, k].sum()),
            "sigma": float(np.sqrt(max(variance[k], 1e-12))),
            "intercept": float(params[k, -1] * (1 - ar[:, k].sum())),
            "mean": float(params[k, -1]),
            "ar": ar[:, k].tolist(),
            "ma": ma[:, k].tolist(),
            "state": state.tolist(),
            "reason": None,
        }
    return out


def _paths(d: list[int], means: list[float], ar: list, states: list, horizons: list[int]) -> list[list[float]]:
    """Forecasts of many series, those with equally many states side by side."""
    out: list = [None] * len(states)
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, state in enumerate(states):
        kinds.setdefault((int(d[i]), len(state)), []).append(i)
    for (order, size), own in kinds.items():
        phi = np.zeros((size - order, len(own)))
        for k, i in enumerate(own):
            phi[: len(ar[i]), k] = ar[i]
        paths = forecast_paths(np.array([states[i] for i in own]).T, phi, order, max(horizons[i] for i in own))
        for k, i in enumerate(own):
            out[i] = (paths[: horizons[i], k] + means[i]).tolist()
    return out


def fit_orders(rows: DataFrame, orders: Sequence[tuple[int, int, int]], period: int = 7, exact_rounds: int = 0) -> DataFrame:
    """Fit every order on every series row; a failed fit keeps a null AIC and the reason.

    Least squares give the parameters, and up to `exact_rounds` steps improve their exact likelihood; the AIC is exact.
    """
    grid = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(d).alias("d"), F.lit(q).alias("q")) for p, d, q in orders])
    jobs = rows.select("*", F.explode(grid).alias("_o")).select(SERIES, "last_date", "y", "_o.*")
    return _fit_jobs(jobs, orders, period, exact_rounds)


def _fit_jobs(jobs: DataFrame, orders: Sequence[tuple[int, int, int]], period: int, exact_rounds: int) -> DataFrame:
    """One fit per row of (series, last_date, y, p, d, q), whose orders are among `orders`."""
    reach = period + max(max(p, q) for p, _, q in orders)
    widest = max(d for _, d, _ in orders)

    @F.pandas_udf(FIT_SCHEMA)
    def fit(y: pd.Series, p: pd.Series, d: pd.Series, q: pd.Series) -> pd.DataFrame:
        fits: list = [None] * len(y)
        by_order: dict[tuple, list[int]] = {}
        for i, order in enumerate(zip(p, d, q)):
            by_order.setdefault(tuple(map(int, order)), []).append(i)
        for order, places in by_order.items():
            for low in range(0, len(places), TOGETHER):
                own = places[low : low + TOGETHER]
                try:
                    found = _fit_together([y.iloc[i] for i in own], *order, period, reach + widest, exact_rounds=exact_rounds)
                except np.linalg.LinAlgError as error:
                    found = [{"reason": str(error)}] * len(own)
                for i, one in zip(own, found):
                    fits[i] = one
        return pd.DataFrame({name: pd.Series([fit.get(name) for fit in fits], dtype=object) for name in FIT_NAMES})

    # spread by order and, within an order, by series: the rows are few but each is a long computation
    tasks = max(jobs.sparkSession.sparkContext.defaultParallelism, int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    groups = max(1, 4 * tasks // len(orders))
    spread = jobs.repartition(4 * tasks, "p", "d", "q", F.pmod(F.xxhash64(SERIES), F.lit(groups)))
    fitted = spread.withColumn("_fit", fit.asNondeterministic()("y", "p", "d", "q"))
    return fitted.select(SERIES, "last_date", "p", "d", "q", "_fit.*")


def best_orders(fits: DataFrame) -> DataFrame:
    """The lowest-AIC fit per series (smallest order on ties)."""
    order = F.struct("aic", "p", "d", "q")
    kept = [c for c in fits.columns if c != SERIES]
    winner = F.min_by(F.struct(*kept), order).alias("_best")
    return fits.where(F.col("aic").isNotNull()).groupBy(SERIES).agg(winner).select(SERIES, "_best.*")


def fit_seasonal(
    daily: DataFrame, target: str = TARGET, auto: bool = True, config: SeasonalConfig = SeasonalConfig()
) -> DataFrame:
    """One row per series; `auto` searches the order grid, else the default order is used.

    The search is in two stages: least squares for the whole grid, judged by their exact AIC, then the `REFINED` best orders
    of a series climb its exact likelihood. A series without a model has a `reason`: that of its fits, or that none of
    its days has a value.
    """
    orders = config.orders() if auto else [config.default_order]
    rows = materialize(series_rows(daily, target), "series_rows")
    fits = materialize(fit_orders(rows, orders, config.period), "seasonal_fits")
    place = Window.partitionBy(SERIES).orderBy("aic", "p", "d", "q")
    chosen = fits.where("aic is not null").withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= REFINED)
    jobs = rows.join(chosen.select(F.col(SERIES).alias("_s"), "p", "d", "q"), F.col(SERIES).eqNullSafe(F.col("_s")))
    best = best_orders(_fit_jobs(jobs.select(SERIES, "last_date", "y", "p", "d", "q"), orders, config.period, EXACT_ROUNDS))
    failed = fits.groupBy(SERIES).agg(F.count("aic").alias("_n"), F.max("last_date").alias("last_date"), F.min("reason").alias("reason"))
    failed = failed.where("_n = 0").drop("_n")
    unknown = daily.groupBy(SERIES).agg(F.count(target).alias("_n")).where("_n = 0").select(SERIES, F.lit("no known value").alias("reason"))
    return best.unionByName(failed, allowMissingColumns=True).unionByName(unknown, allowMissingColumns=True)


def seasonal_forecast(models: DataFrame, days: int | None = None) -> DataFrame:
    """Forecasts for `days` days, or for the `horizon` column of each model row.

    A horizon under 1 has no days; a series without a model has one row without a date, whose status is the reason.
    """
    steps = models if days is None else models.withColumn("horizon", F.lit(days))

    @F.pandas_udf("array<double>")
    def path(horizon: pd.Series, d: pd.Series, mean: pd.Series, ar: pd.Series, state: pd.Series) -> pd.Series:
        return pd.Series(_paths(d.tolist(), mean.tolist(), ar.tolist(), state.tolist(), [int(h) for h in horizon]))

    values = path("horizon", "d", "mean", "ar", "state")
    ahead = F.col("_i") + 1
    found = (
        steps.where("reason is null and horizon >= 1")
        .withColumn("_path", values)
        .select(SERIES, "last_date", F.posexplode("_path").alias("_i", "prediction"))
        .select(SERIES, F.date_add("last_date", ahead).alias(DATE), ahead.alias("days_ahead"), "prediction", F.lit("seasonal_arima").alias("method"), F.lit("ok").alias("status"))
    )
    lost = steps.where("reason is not null").select(SERIES, F.lit("seasonal_arima").alias("method"), F.col("reason").alias("status"))
    return found.unionByName(lost, allowMissingColumns=True)


def seasonal_range(models: DataFrame, ranges: DataFrame) -> DataFrame:
    """Forecasts inside (series_id, start_date, end_date); an end in the past means the next 30 days.

    A series is simulated once, to its furthest end; ranges meet it on series and date. A range that cannot be answered has
    one row without a date, whose status says why: unknown series, the series' reason, or an empty range.
    """
    known = models.select(F.col(SERIES).alias("_s"), "last_date", "reason", F.lit(True).alias("_found"))
    dated = ranges.join(known, F.col(SERIES).eqNullSafe(F.col("_s")), "left").drop("_s")
    past = F.col("end_date") <= F.col("last_date")
    dated = dated.withColumn("end_date", F.when(past, F.date_add("last_date", 30)).otherwise(F.col("end_date")))
    first = F.greatest(F.col("start_date"), F.date_add("last_date", 1))
    status = F.when(F.col("_found").isNull(), "unknown series").when(F.col("reason").isNotNull(), F.col("reason"))
    dated = dated.withColumn("status", status.when(F.coalesce(first > F.col("end_date"), F.lit(True)) | F.col("start_date").isNull(), "empty range").otherwise("ok"))
    answered = dated.where("status = 'ok'")
    until = answered.groupBy(SERIES).agg(F.max(F.datediff("end_date", "last_date")).alias("horizon"))
    days = seasonal_forecast(models.where("reason is null").join(until, SERIES)).drop("status")
    wanted = answered.withColumn(DATE, F.explode(F.sequence(first, F.col("end_date")))).drop("last_date", "reason", "_found")
    lost = dated.where("status <> 'ok'").drop("last_date", "reason", "_found").withColumn("method", F.lit("seasonal_arima"))
    return wanted.join(days, [SERIES, DATE]).unionByName(lost, allowMissingColumns=True)


def seasonal_holdout(models: DataFrame, test: DataFrame, target: str = TARGET) -> DataFrame:
    """Forecast and actual of every test day, joined on date; days of a series without a model have no forecast and its reason as status."""
    ends = test.groupBy(SERIES).agg(F.max(DATE).alias("_end"))
    steps = models.join(ends, SERIES).withColumn("horizon", F.datediff("_end", "last_date"))
    forecast = seasonal_forecast(steps.where("reason is null").drop("_end")).select(SERIES, DATE, "prediction")
    reasons = models.select(SERIES, F.coalesce("reason", F.lit("ok")).alias("status"))
    held = test.select(SERIES, DATE, target).join(forecast, [SERIES, DATE], "left").join(reasons, SERIES, "left")
    return held.withColumn("status", F.coalesce("status", F.lit("unknown series")))


def backtest(daily: DataFrame, target: str = TARGET, test_size: float = 0.2, auto: bool = True) -> DataFrame:
    """Fit on the first part of every series, score the rest; a series that cannot be scored keeps a row with its reason."""
    split = materialize(time_split(daily.select(SERIES, DATE, target), test_size), "split")
    train_rows, test = split.where(F.col("split") == "train"), split.where(F.col("split") == "test")
    models = fit_seasonal(train_rows, target, auto)
    scores = regression_metrics(seasonal_holdout(models, test, target), target)
    reasons = split.select(SERIES).distinct().join(models.select(SERIES, "reason"), SERIES, "left")
    reasons = reasons.select(F.col(SERIES).alias("_s"), "reason")
    joined = reasons.join(scores, F.col("_s").eqNullSafe(F.col(SERIES)), "left").withColumn(SERIES, F.col("_s"))
    status = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("n").isNull(), "nothing to score").otherwise("ok")
    return joined.withColumn("status", status).drop("_s", "reason")
