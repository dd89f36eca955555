import datetime as dt

import numpy as np
import pytest
from helpers import DAY0, daily_frame

from hourloom.config import SeasonalConfig
from hourloom.operators import model, seasonal


def weekly_series(seed, n=700, ar=0.5):
    rng = np.random.default_rng(seed)
    shape = np.array([0, 1, 2, 1, 0, 6, 5.0])
    e, x = rng.normal(0, 1, n), np.zeros(n)
    for t in range(1, n):
        x[t] = ar * x[t - 1] + e[t]
    return 30 + shape[np.arange(n) % 7] + x


def test_recovers_planted_coefficients(spark):
    rng = np.random.default_rng(0)
    e, y = rng.normal(0, 1, 4000), np.zeros(4000)
    for t in range(8, 4000):
        y[t] = 0.6 * y[t - 1] + 0.3 * y[t - 7] - 0.18 * y[t - 8] + e[t]
    fit = seasonal.fit_orders(seasonal.series_rows(daily_frame(spark, {"a": list(y)})), [(1, 0, 0)]).first()
    assert fit["ar"][0] == pytest.approx(0.6, abs=0.05) and fit["ar"][6] == pytest.approx(0.3, abs=0.1) and fit["ar"][7] == pytest.approx(-0.18, abs=0.08)
    assert fit["sigma"] == pytest.approx(1.0, abs=0.05)


def test_search_keeps_the_lowest_aic_and_reports_failures(spark):
    daily = daily_frame(spark, {"a": list(weekly_series(1)), "short": [1.0, 2.0, 3.0]})
    fits = seasonal.fit_orders(seasonal.series_rows(daily), SeasonalConfig().orders()).cache()
    assert fits.count() == 36
    assert {r["reason"] for r in fits.where("series_id = 'short'").collect()} == {"too short"}
    best = seasonal.best_orders(fits).collect()
    assert [b["series_id"] for b in best] == ["a"]
    assert best[0]["aic"] == min(r["aic"] for r in fits.where("aic is not null").collect())


def test_backtest_beats_last_week(spark):
    y = list(weekly_series(2)) + []
    daily = daily_frame(spark, {"a": y, "b": list(weekly_series(3) * 2)})
    scores = {r["series_id"]: r["mae"] for r in seasonal.backtest(daily, auto=True).collect()}
    for name, values in (("a", np.array(y)), ("b", weekly_series(3) * 2)):
        cut = int(len(values) * 0.8)
        repeated = np.array([values[cut - 7 + i % 7] for i in range(len(values) - cut)])
        assert scores[name] < np.mean(np.abs(values[cut:] - repeated))


def test_differenced_forecasts_continue_the_level(spark):
    y = [5.0 * i + (10 if i % 7 >= 5 else 0) for i in range(200)]
    models = seasonal.fit_seasonal(daily_frame(spark, {"a": y}), auto=False)
    rows = seasonal.seasonal_forecast(models, 14).orderBy("date").collect()
    expected = [5.0 * i + (10 if i % 7 >= 5 else 0) for i in range(200, 214)]
    np.testing.assert_allclose([r["prediction"] for r in rows], expected, atol=2.0)
    assert rows[0]["date"] == DAY0 + dt.timedelta(days=200)


def test_range_in_the_past_means_thirty_days(spark):
    models = seasonal.fit_seasonal(daily_frame(spark, {"a": list(weekly_series(4))}), auto=False)
    last = DAY0 + dt.timedelta(days=699)
    ranges = [("a", last - dt.timedelta(days=9), last), ("a", last + dt.timedelta(days=5), last + dt.timedelta(days=8))]
    rows = seasonal.seasonal_range(models, spark.createDataFrame(ranges, "series_id string, start_date date, end_date date"))
    got = {}
    for r in rows.collect():
        got.setdefault(r["start_date"], []).append(r["days_ahead"])
    assert sorted(got[ranges[0][1]]) == list(range(1, 31)) and sorted(got[ranges[1][1]]) == [5, 6, 7, 8]


def test_holdout_joins_on_date(spark):
    daily = daily_frame(spark, {"a": list(weekly_series(5))})
    split = model.time_split(daily)
    models = seasonal.fit_seasonal(split.where("split = 'train'"), auto=False)
    held = seasonal.seasonal_holdout(models, split.where("split = 'test' and day(date) % 3 = 0"))
    assert held.count() == split.where("split = 'test' and day(date) % 3 = 0").count()


def test_horizons_have_no_cap(spark):
    models = seasonal.fit_seasonal(daily_frame(spark, {"a": list(weekly_series(6))}), auto=False)
    assert seasonal.seasonal_forecast(models, 500).count() == 500
    last = DAY0 + dt.timedelta(days=699)
    ranges = [("a", last + dt.timedelta(days=1), last + dt.timedelta(days=366)), ("a", last + dt.timedelta(days=3), last + dt.timedelta(days=4))]
    rows = seasonal.seasonal_range(models, spark.createDataFrame(ranges, "series_id string, start_date date, end_date date"))
    assert rows.count() == 368
    daily = daily_frame(spark, {"a": list(weekly_series(7, 2400))})
    split = model.time_split(daily)
    held = seasonal.seasonal_holdout(seasonal.fit_seasonal(split.where("split = 'train'"), auto=False), split.where("split = 'test'"))
    assert held.count() == 480


def test_missing_dates_keep_the_week(spark):
    y = list(weekly_series(8, 420))
    full = daily_frame(spark, {"a": y})
    gappy = full.where("pmod(datediff(date, date'2020-01-06'), 9) <> 4")
    errors = []
    for daily in (full, gappy):
        split = model.time_split(daily)
        held = seasonal.seasonal_holdout(seasonal.fit_seasonal(split.where("split = 'train'"), auto=False), split.where("split = 'test'"))
        errors.append(held.selectExpr("avg(abs(prediction - total_daily_consumption)) AS e").first()["e"])
    assert errors[1] < 2 * errors[0]


def test_series_fitted_together_equal_series_fitted_alone():
    series = [list(weekly_series(s, n)) for s, n in ((1, 300), (2, 500), (3, 420))]
    series[1][100:104] = [None] * 4
    for order in ((1, 1, 1), (2, 0, 1), (0, 0, 2)):
        together = seasonal._fit_together(series, *order, 7, 10)
        for values, fit in zip(series, together):
            alone = seasonal._fit_together([values], *order, 7, 10)[0]
            assert fit["sigma"] == pytest.approx(alone["sigma"], rel=0.005) and fit["known_days"] == alone["known_days"]
            assert fit["loglik"] == pytest.approx(alone["loglik"], rel=0.002)


def dense_log_likelihood(y, ar, ma, d, first):
    """Gaussian density of the known days from `first` on, from the covariance of all of them, at the best variance."""
    known = np.flatnonzero(~np.isnan(y))
    n = len(y)
    # Moving-average weights of the process, and from them its covariance.
    psi = np.zeros(6000)
    psi[0] = 1.0
    for i in range(1, len(psi)):
        psi[i] = (ma[i - 1] if i <= len(ma) else 0.0) + sum(a * psi[i - k] for k, a in enumerate(ar, 1) if k <= i)
    lagged = np.array([psi[: len(psi) - h] @ psi[h:] for h in range(n)])
    cov = lagged[np.abs(np.arange(n)[:, None] - np.arange(n)[None, :])]
    if d:
        # The level before the first known day is free: differences from that day on are sums of the process.
        sums = np.tril(np.ones((n - 1, n - 1)))
        cov, x, at = sums @ cov[1:, 1:] @ sums.T, y[1:] - y[0], known[1:] - 1
        cov, x = cov[np.ix_(at, at)], x[at]
        base = None
    else:
        cov, x = cov[np.ix_(known, known)], y[known]
        base = (cov[:1, :1], x[:1]) if first else None

    def terms(c, v):
        return np.linalg.slogdet(c)[1], float(v @ np.linalg.solve(c, v)), len(v)

    log_det, square, count = terms(cov, x)
    if base is not None:
        log_det, square, count = (a - b for a, b in zip((log_det, square, count), terms(*base)))
    return -0.5 * (count * (np.log(2 * np.pi * square / count) + 1) + log_det)


@pytest.mark.parametrize(("p", "d", "q"), [(0, 0, 0), (1, 0, 1), (2, 0, 2), (1, 1, 1), (2, 1, 0), (0, 1, 2)])
@pytest.mark.parametrize("holes", [[], [3, 4, 11, 28]])
def test_likelihood_equals_the_dense_gaussian(p, d, q, holes):
    rng = np.random.default_rng(p + 10 * d + 100 * q)
    series, wanted = [], []
    params = np.concatenate([rng.uniform(-0.4, 0.4, p), [0.6], rng.uniform(-0.6, 0.6, q), [-0.3, 0.0 if d else 2.0]])
    ar, ma = (w[:, 0] for w in seasonal._by_lag(params[None], p, q, 7))
    for n in (30, 21, 40):
        y = rng.normal(0, 1, n).cumsum() if d else rng.normal(2, 1, n)
        y[[h for h in holes if h < n - 1]] = np.nan
        series.append([None if np.isnan(v) else v for v in y])
        wanted.append([dense_log_likelihood(y if d else y - 2.0, ar, ma, d, first) for first in (0, 1)])
    found = seasonal.Exact(series, d).filtered(np.arange(3), np.tile(params, (3, 1, 1)).reshape(3, 1, -1), p, q, 7)
    np.testing.assert_allclose(found.log_likelihood(1)[0], [w[1] for w in wanted], atol=1e-6)
    if not d:
        np.testing.assert_allclose(found.log_likelihood(0)[0], [w[0] for w in wanted], atol=1e-6)


def test_likelihood_climbs_and_forecasts_follow_the_states():
    y = list(weekly_series(11, 400))
    y[50:53] = [None] * 3
    loose = seasonal._fit_together([y], 1, 0, 1, 7, 10, exact_rounds=0)[0]
    fit = seasonal._fit_together([y], 1, 0, 1, 7, 10)[0]
    assert fit["loglik"] >= loose["loglik"] and fit["known_days"] == 396
    path = seasonal._paths([0], [fit["mean"]], [fit["ar"]], [fit["state"]], [21])[0]
    params_free = np.array([v for v in y[-70:] if v is not None])
    assert np.abs(np.array(path[:7]) - params_free[-14:].reshape(2, 7).mean(axis=0)).mean() < 2.5


def test_every_series_has_a_row(spark):
    daily = daily_frame(spark, {"a": list(weekly_series(1, 200)), "short": [1.0, 2.0, 3.0], "empty": [None] * 20})
    models = seasonal.fit_seasonal(daily, auto=False)
    assert {r["series_id"]: r["reason"] for r in models.collect()} == {"a": None, "short": "too short", "empty": "no known value"}
    last = DAY0 + dt.timedelta(days=199)
    asked = [(s, last + dt.timedelta(days=1), last + dt.timedelta(days=2)) for s in ("a", "short", "empty", "nowhere", None)]
    asked += [("a", last + dt.timedelta(days=9), last + dt.timedelta(days=8)), ("a", None, last + dt.timedelta(days=8))]
    rows = seasonal.seasonal_range(models, spark.createDataFrame(asked, "series_id string, start_date date, end_date date")).collect()
    got = sorted((str(r["series_id"]), r["status"], r["prediction"] is None) for r in rows)
    assert got == sorted([
        ("a", "ok", False), ("a", "ok", False), ("a", "empty range", True), ("a", "empty range", True), ("short", "too short", True),
        ("empty", "no known value", True), ("nowhere", "unknown series", True), ("None", "unknown series", True),
    ])
    scores = {r["series_id"]: (r["status"], r["n"]) for r in seasonal.backtest(daily, auto=False).collect()}
    assert scores == {"a": ("ok", 40), "short": ("too short", None), "empty": ("no known value", None)}
    assert {r["status"] for r in seasonal.seasonal_forecast(models, 3).where("date is null").collect()} == {"too short", "no known value"}
