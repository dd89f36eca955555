"""From a question in words to its answer, and everything a run needs to give one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.config import SERIES, RunConfig
from hourloom.operators import forecast, model, requests
from hourloom.plans.training import TrainedRun, holdout_sigma, states_for, train_run
from hourloom.session import materialize
from hourloom.sources import tables


@dataclass(frozen=True)
class Forecaster:
    """State rows and trees of a run, with the inputs' weights for explanations."""

    states: DataFrame
    forest: forecast.ForestArrays
    importances: dict[str, float]


@dataclass(frozen=True)
class CompleteRun:
    run: TrainedRun
    folds: DataFrame
    importances: DataFrame
    forecaster: Forecaster


def forecaster_of(run: TrainedRun) -> Forecaster:
    """States from the labelled clean days, their spread from the test days, and the forest as arrays."""
    scored = model.predict(run.model, run.features, run.inputs)
    sigma = holdout_sigma(scored.where(F.col("split") == "test"))
    states = materialize(states_for(run.clean, run.daily, sigma), "states")
    spark = run.daily.sparkSession
    weights = dict(zip(run.inputs, map(float, run.model.stages[-1].featureImportances.toArray())))
    return Forecaster(states, forecast.forest_arrays(spark, run.model), weights)


def complete_run(daily: DataFrame, profiles: DataFrame, config: RunConfig = RunConfig(), root: str | None = None) -> CompleteRun:
    """Training, cross-validation, importances and the forecaster; `root` keeps the tables and the model."""
    run = train_run(daily, profiles, config)
    train_rows = run.features.where(F.col("split") == "train")
    folds = model.cross_validate(train_rows, run.inputs, model.forest(config=config.forest))
    importances = model.importance_table(run.model, run.inputs, daily.sparkSession)
    if root is not None:
        tables.write_prepared({"daily": run.daily, "clean": run.clean, "clustered": run.clustered, "features": run.features}, root)
        tables.save_model(run.model, run.inputs, f"{root}/model")
    return CompleteRun(run, folds, importances, forecaster_of(run))


def answer_questions(
    questions: DataFrame, daily: DataFrame, features_table: DataFrame, fitted, inputs: list[str], forecaster: Forecaster
) -> DataFrame:
    """(request_id, series_id, query) to one record each: its date, the prediction, and a `status` that says why not.

    Days that `daily` marks as anomalous were not learnt from; a question about one has the status removed_day.
    """
    dated = requests.resolve_requests(questions, requests.anchor_dates(daily)).select("request_id", SERIES, "query", "date")
    marked = daily if "is_anomaly" in daily.columns else None
    return forecast.answer_requests(
        dated, features_table, forecaster.states, fitted, forecaster.forest, inputs, forecaster.importances, marked
    )
