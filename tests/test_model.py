import numpy as np
import pytest
from helpers import daily_frame
from pyspark.sql import functions as F

from hourloom.config import TARGET, BoostingConfig, ForestConfig
from hourloom.operators import features, model
from hourloom.sources import tables

SMALL = ForestConfig(trees=8, depth=5)


@pytest.fixture(scope="module")
def weekly(spark):
    rng = np.random.default_rng(8)
    days = np.arange(420)
    level = 20 + 6 * (days % 7 >= 5) + 3 * np.sin(2 * np.pi * days / 90)
    y = level + rng.normal(0, 0.5, 420)
    y[1:] += 0.6 * (y[:-1] - level[:-1])
    table = features.build_features(daily_frame(spark, {"a": list(y), "b": list(y * 2 + rng.normal(0, 0.5, 420))}))
    inputs = features.model_inputs(table.columns)
    usable = model.time_split(model.drop_unusable(table, TARGET, inputs)).cache()
    fitted = model.train(usable.where("split = 'train'"), inputs, model.forest(config=SMALL))
    return usable, inputs, fitted


def test_split_is_by_time(spark):
    rows = model.time_split(daily_frame(spark, {"a": [1.0] * 11, "b": [2.0]})).collect()
    a = sorted((r["date"], r["split"]) for r in rows if r["series_id"] == "a")
    assert [s for _, s in a] == ["train"] * 8 + ["test"] * 3
    assert [r["split"] for r in rows if r["series_id"] == "b"] == ["test"]


@pytest.mark.parametrize("n", [12, 17, 61, 3])
def test_folds_expand_in_time(spark, n):
    plan = model.fold_plan(daily_frame(spark, {"a": [float(i) for i in range(n)]})).orderBy("date").collect()
    size = n // 6
    expected = [None] * n
    for fold in range(1, 6):
        start = n - (6 - fold) * size
        expected[start : start + size] = [fold] * size
    assert [r["fold"] for r in plan] == expected


def test_forest_beats_the_weekday_mean(weekly):
    usable, inputs, fitted = weekly
    test = model.predict(fitted, usable.where("split = 'test'"), inputs)
    forest = {r["series_id"]: r["mae"] for r in model.regression_metrics(test).collect()}
    naive = {r["series_id"]: r["mae"] for r in model.regression_metrics(test, prediction="dow_typical_consumption").collect()}
    assert all(forest[s] < 0.8 * naive[s] for s in ("a", "b"))


def test_boosting_and_importances(spark, weekly):
    usable, inputs, fitted = weekly
    boosted = model.train(usable.where("split = 'train'"), inputs, model.boosting(config=BoostingConfig(rounds=3, depth=3)))
    assert model.predict(boosted, usable, inputs).where("prediction is null").count() == 0
    table = model.importance_table(fitted, inputs, spark)
    assert table.count() == len(inputs)
    assert table.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    top = [r["importance"] for r in model.top_features(table, 3).collect()]
    assert top == sorted(top, reverse=True) and len(top) == 3


def test_metrics_leave_zero_actuals_out_of_mape(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 2.0, 1.0), ("a", 4.0, 5.0), ("a", None, 1.0)], f"series_id string, {TARGET} double, prediction double")
    row = model.regression_metrics(df).first()
    assert (row["n"], row["zero_actuals"]) == (3, 1)
    assert row["mae"] == pytest.approx(1.0) and row["rmse"] == pytest.approx(1.0)
    assert row["mape"] == pytest.approx((50 + 25) / 2)
    assert row["r2"] == pytest.approx(1 - 3 / 8)


def test_cross_validation_scores_every_fold(weekly):
    usable, inputs, _ = weekly
    scores = model.cross_validate(usable.where("split = 'train'"), inputs, model.forest(config=ForestConfig(trees=2, depth=3)))
    rows = scores.collect()
    maes = [r["mae"] for r in rows]
    assert len(rows) == 5
    assert rows[0]["cv_mae"] == pytest.approx(np.mean(maes)) and rows[0]["cv_mae_std"] == pytest.approx(np.std(maes))


def test_saved_model_predicts_the_same(spark, weekly, tmp_path):
    usable, inputs, fitted = weekly
    tables.save_model(fitted, inputs, str(tmp_path / "m"))
    tables.save_model(fitted, inputs, str(tmp_path / "m"))
    loaded, names = tables.load_model(spark, str(tmp_path / "m"))
    assert names == inputs
    a = model.predict(fitted, usable, inputs).select("series_id", "date", "prediction")
    b = model.predict(loaded, usable, names).select("series_id", "date", "prediction")
    assert a.exceptAll(b).count() == 0


def test_contributions_are_ordered_by_size(spark):
    df = spark.createDataFrame([(2.0, -9.0, None, 1.0)], "a double, b double, c double, d double")
    top = df.select(model.contributions({"a": 1.0, "b": 0.5, "c": 9.0, "d": 2.0}, 3).alias("t")).first()["t"]
    assert [(t["feature"], t["weight"]) for t in top] == [("b", -4.5), ("a", 2.0), ("d", 2.0)]


def test_score_dates_returns_the_features_used(spark, weekly):
    usable, inputs, fitted = weekly
    wanted = usable.where("split = 'test'").select("series_id", "date").limit(3)
    rows = model.score_dates(fitted, usable, wanted, inputs).collect()
    assert len(rows) == 3 and set(rows[0]["features_used"].asDict()) == set(inputs)
