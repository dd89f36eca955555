import numpy as np
import pytest
from helpers import daily_frame, profile_frame

from hourloom.config import AnomalyConfig, ForestConfig, KMeansConfig, RunConfig
from hourloom.plans import answers
from hourloom.sources import tables

N = 260


@pytest.fixture(scope="module")
def complete(spark, tmp_path_factory):
    rng = np.random.default_rng(2)
    days = np.arange(N)
    values = 20 + 5 * (days % 7 >= 5) + rng.normal(0, 0.5, N)
    values[100] = 400.0
    extra = lambda i, v: (v / 24, abs(v) / 50, v / 10, v / 40)
    daily = daily_frame(spark, {"a": list(values)}, extra)
    profiles = profile_frame(spark, [("a", d, np.full(24, values[d] / 24) + rng.normal(0, 0.01, 24)) for d in range(N)])
    config = RunConfig(
        anomaly=AnomalyConfig(trees=20), kmeans=KMeansConfig(restarts=2, partitions=1), forest=ForestConfig(trees=5, depth=5, partitions=1), clusters=2
    )
    root = str(tmp_path_factory.mktemp("run"))
    return answers.complete_run(daily, profiles, config, root), root


def test_one_call_gives_all_parts(spark, complete):
    made, root = complete
    assert made.folds.count() == 5 and made.importances.count() == len(made.run.inputs)
    assert sum(made.forecaster.importances.values()) == pytest.approx(1.0)
    assert "yesterday_cluster" in made.run.inputs and "cluster_rule" in made.forecaster.states.columns
    loaded, inputs = tables.load_model(spark, f"{root}/model")
    assert inputs == made.run.inputs and tables.read_prepared(spark, root, "daily").count() == N


def test_a_question_becomes_an_answer(spark, complete):
    made, _ = complete
    run = made.run
    asked = ["tomorrow please", "usage on 2020-04-15", "what about 2031-01-01", "how much?", "on 2020-05-20", "next month"]
    questions = spark.createDataFrame([(i, "a", q) for i, q in enumerate(asked)] + [(9, "zz", "tomorrow")], "request_id int, series_id string, query string")
    got = {r["request_id"]: r for r in answers.answer_questions(questions, run.daily, run.features, run.model, run.inputs, made.forecaster).collect()}
    assert {i: r["status"] for i, r in got.items()} == {0: "ok", 1: "removed_day", 2: "too_far", 3: "no_date", 4: "ok", 5: "ok", 9: "unknown_series"}
    assert got[0]["prediction"] == pytest.approx(25, abs=7) and got[4]["actual"] is not None
    assert got[0]["last_date"] is not None and got[1]["prediction"] is None
