import datetime as dt

import numpy as np
import pytest
from helpers import DAY0, daily_frame
from pyspark.sql import functions as F

from hourloom.config import TARGET, BoostingConfig, ForestConfig
from hourloom.operators import features, forecast, model

N = 200


@pytest.fixture(scope="module")
def setup(spark):
    rng = np.random.default_rng(1)
    days = np.arange(N)
    values = {s: list(k * (20 + 5 * (days % 7 >= 5)) + rng.normal(0, 1, N)) for s, k in (("a", 1), ("b", 3))}
    daily = daily_frame(spark, values)
    table = features.build_features(daily)
    inputs = features.model_inputs(table.columns)
    fitted = model.train(table, inputs, model.forest(config=ForestConfig(trees=6, depth=6)))
    return daily, table.cache(), inputs, fitted, forecast.forest_arrays(spark, fitted)


def test_arrays_predict_like_the_model(spark, setup):
    _, table, inputs, fitted, forest = setup
    rows = model.predict(fitted, table, inputs).select(*inputs, "prediction").toPandas()
    np.testing.assert_allclose(forest.predict(rows[inputs].to_numpy(float)), rows["prediction"], rtol=1e-12)
    boosted = model.train(table, inputs, model.boosting(config=BoostingConfig(rounds=4, depth=3)))
    rows = model.predict(boosted, table, inputs).select(*inputs, "prediction").toPandas()
    arrays = forecast.forest_arrays(spark, boosted)
    np.testing.assert_allclose(arrays.predict(rows[inputs].to_numpy(float)), rows["prediction"], rtol=1e-12)


def test_recursion_equals_a_loop_over_transform(spark, setup):
    daily, _, inputs, fitted, forest = setup
    states = forecast.forecast_states(daily, daily)
    got = {(r["series_id"], r["days_ahead"]): r["prediction"] for r in forecast.forecast_ahead(states, forest, inputs, 6).collect()}
    history = daily
    for step in range(1, 7):
        day = DAY0 + dt.timedelta(days=N - 1 + step)
        ahead = spark.createDataFrame([("a", day, None), ("b", day, None)], daily.schema)
        made = features.build_features(history.unionByName(ahead)).where(F.col("date") == day)
        rows = model.predict(fitted, made, inputs).select("series_id", "date", "prediction").collect()
        assert len(rows) == 2
        for r in rows:
            assert got[r["series_id"], step] == pytest.approx(r["prediction"], rel=1e-9)
        step_rows = [(r["series_id"], r["date"], r["prediction"]) for r in rows]
        history = spark.createDataFrame([tuple(r) for r in history.collect()] + step_rows, daily.schema)


def test_interval_grows_and_never_goes_below_zero(spark, setup):
    daily, _, inputs, _, forest = setup
    sigma = spark.createDataFrame([("a", 50.0)], "series_id string, sigma double")
    rows = forecast.forecast_ahead(forecast.forecast_states(daily, daily, sigma), forest, inputs, 9).collect()
    for r in rows:
        spread = (50.0 if r["series_id"] == "a" else 2.626) * np.sqrt(r["days_ahead"])
        assert r["uncertainty"] == pytest.approx(spread)
        assert r["ci_lower"] == pytest.approx(max(0, r["prediction"] - 1.96 * spread))
    with pytest.raises(ValueError):
        forecast.forecast_ahead(forecast.forecast_states(daily, daily), forest, inputs, 366)


def test_ranges_simulate_all_days_but_return_theirs(spark, setup):
    daily, _, inputs, _, forest = setup
    states = forecast.forecast_states(daily, daily)
    last = DAY0 + dt.timedelta(days=N - 1)
    wanted = [("a", last + dt.timedelta(days=10), last + dt.timedelta(days=30)), ("b", last - dt.timedelta(days=5), last + dt.timedelta(days=2))]
    ranges = spark.createDataFrame(wanted, "series_id string, start_date date, end_date date")
    rows = forecast.forecast_ranges(states, forest, inputs, ranges).collect()
    whole = {(r["series_id"], r["date"]): r["prediction"] for r in forecast.forecast_ahead(states, forest, inputs, 30).collect()}
    assert sorted(r["days_ahead"] for r in rows if r["series_id"] == "a") == list(range(10, 31))
    assert sorted(r["days_ahead"] for r in rows if r["series_id"] == "b") == [1, 2]
    assert all(r["prediction"] == pytest.approx(whole[r["series_id"], r["date"]]) for r in rows)


def test_clusters_follow_the_learned_rule(spark):
    daily = daily_frame(spark, {"a": [1.0, 2, 3, 4, 5, 6, 7] * 4}).withColumn("cluster", (F.weekday("date") >= 5).cast("int") * 3)
    daily = features.calendar_features(daily)
    rule = {(r["season"], r["is_weekend"]): r["expected_cluster"] for r in forecast.learned_cluster_rule(daily).collect()}
    assert rule[0, 0] == 0 and rule[0, 1] == 3
    state = forecast.forecast_states(daily, daily).first()
    assert state["cluster_avg"] == {0: 3.0, 3: 6.5} and len(state["recent"]) == 28
    fixed = spark.createDataFrame([(dt.date(2020, 7, 4),), (dt.date(2020, 1, 4),), (dt.date(2020, 1, 6),)], "date date")
    assert [r[0] for r in fixed.select(forecast.season_cluster_rule(F.col("date"))).collect()] == [1, 2, 0]


def test_requests_are_routed_by_date(spark, setup):
    daily, table, inputs, fitted, forest = setup
    states = forecast.forecast_states(daily, daily)
    last = DAY0 + dt.timedelta(days=N - 1)
    asked = [(1, "a", last), (2, "a", last + dt.timedelta(days=3)), (3, "b", DAY0), (4, "zz", last), (5, "b", last + dt.timedelta(days=400)), (6, "a", last + dt.timedelta(days=3))]
    requests = spark.createDataFrame(asked, "request_id long, series_id string, date date")
    importances = dict(zip(inputs, map(float, fitted.stages[-1].featureImportances.toArray())))
    rows = {r["request_id"]: r for r in forecast.answer_requests(requests, table, states, fitted, forest, inputs, importances).collect()}
    assert len(rows) == 6
    assert rows[1]["method"] == "random_forest" and rows[1]["error"] == pytest.approx(abs(rows[1]["prediction"] - rows[1]["actual"]))
    assert len(rows[1]["top_features"]) == 5 and rows[1]["day_of_week"] == last.strftime("%A")
    assert rows[2]["method"] == "recursive_rf" and rows[2]["ci_upper"] > rows[2]["prediction"] and rows[2]["actual"] is None
    assert rows[6]["prediction"] == rows[2]["prediction"]
    assert all(rows[i]["prediction"] is None for i in (3, 4, 5))


def test_history_stats(spark):
    daily = features.calendar_features(daily_frame(spark, {"a": [1.0, 2.0, 3.0]})).withColumn("cluster", F.lit(7))
    rows = {(r["kind"], r["key"]): r["mean"] for r in forecast.history_stats(daily).collect()}
    assert rows == {("weekday", 0): 1.0, ("weekday", 1): 2.0, ("weekday", 2): 3.0, ("cluster", 7): 2.0, ("overall", None): 2.0}


def test_summary(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "series_id string, prediction double")
    assert tuple(forecast.range_summary(rows).first()) == ("a", 2.0, 1.0, 3.0, 4.0)
    assert TARGET == "total_daily_consumption"


def test_ranges_are_judged_one_by_one(spark, setup):
    daily, _, inputs, _, forest = setup
    states = forecast.forecast_states(daily, daily)
    last = DAY0 + dt.timedelta(days=N - 1)
    spans = [("a", 1, 7), ("a", 360, 370), ("b", 3, 3), ("b", 5, 4), ("b", -9, 0), ("c", 1, 2)]
    rows = [(i, s, last + dt.timedelta(days=x), last + dt.timedelta(days=y)) for i, (s, x, y) in enumerate(spans)]
    ranges = spark.createDataFrame([*rows, (6, "a", None, None)], "id int, series_id string, start_date date, end_date date")
    status = {r["id"]: r["status"] for r in forecast.check_forecast_ranges(states, ranges).collect()}
    assert status == {0: "ok", 1: "too_far", 2: "ok", 3: "empty_range", 4: "in_the_past", 5: "unknown_series", 6: "no_date"}
    days = forecast.forecast_ranges(states, forest, inputs, ranges)
    assert sorted((r["id"], r["days_ahead"]) for r in days.collect()) == [(0, k) for k in range(1, 8)] + [(2, 3)]


def test_short_histories_have_a_status(spark, setup):
    daily, _, inputs, _, forest = setup
    short = daily.where(F.col("date") >= DAY0 + dt.timedelta(days=N - 10))
    states = forecast.forecast_states(short, short)
    assert forecast.forecast_ahead(states, forest, inputs, 3).count() == 0
    day = DAY0 + dt.timedelta(days=N + 1)
    ranges = spark.createDataFrame([("a", day, day)], "series_id string, start_date date, end_date date")
    assert [r["status"] for r in forecast.check_forecast_ranges(states, ranges).collect()] == ["short_history"]


def test_inputs_without_a_source_are_refused(spark, setup):
    daily, _, inputs, _, forest = setup
    with pytest.raises(ValueError, match="yesterday_cluster"):
        forecast.forecast_ahead(forecast.forecast_states(daily, daily), forest, [*inputs, "yesterday_cluster"], 2)


def test_answers_say_why(spark, setup):
    daily, table, inputs, fitted, forest = setup
    states = forecast.forecast_states(daily, daily)
    flagged = daily.withColumn("is_anomaly", F.col("date") == DAY0 + dt.timedelta(days=2))
    asked = [("a", 100), ("a", 2), ("a", 1), ("a", N + 3), ("a", N + 900), ("x", 5), ("a", None)]
    rows = [(i, s, None if d is None else DAY0 + dt.timedelta(days=d)) for i, (s, d) in enumerate(asked)]
    requests = spark.createDataFrame(rows, "request_id int, series_id string, date date")
    answers = forecast.answer_requests(requests, table, states, fitted, forest, inputs, {inputs[0]: 1.0}, flagged).collect()
    got = {r["request_id"]: (r["status"], r["prediction"] is not None) for r in answers}
    assert got == {
        0: ("ok", True), 1: ("removed_day", False), 2: ("not_scored", False), 3: ("ok", True), 4: ("too_far", False),
        5: ("unknown_series", False), 6: ("no_date", False),
    }
