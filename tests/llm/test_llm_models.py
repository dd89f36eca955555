"""Classifiers: held-out accuracy on planted classes, odd rows, and models without labels."""

import random

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import ODD_TEXTS, documents

from hourloom.llm import quality, toxicity, training
from hourloom.llm.training import Sample, calibrate, class_weights, sigmoid

STEMS = ["vexo", "grumb", "zotra", "klimp"]


def prose(rng, n):
    return " ".join("".join(rng.choice(["on", "the", "er", "ti", "an", "re", "sh"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(9)
    rows = []
    for i in range(600):
        words = prose(rng, rng.randint(20, 200)).split()
        toxic = i % 5 == 0
        if i % 4 == 1:
            words = [w.upper() + "!!" for w in words[:10]] * (len(words) // 10 + 1)
        for _ in range(2 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(STEMS) + rng.choice(["en", "ung", "s", "ia", "or"]))
        rows.append((i, " ".join(words), int(toxic), int(i % 4 != 1)))
    return rows


def tables(spark, rows):
    docs = documents(spark, [r[1] for r in rows], ids=[r[0] for r in rows], clash=True)
    labels = spark.createDataFrame([(r[0], r[3], r[2]) for r in rows if r[0] < 400], "doc_id bigint, quality int, toxic int")
    return docs, labels


def test_toxicity_on_held_out_rows(spark, labelled):
    docs, labels = tables(spark, labelled)
    model = toxicity.train(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_texts(docs, model).collect()}
    wrong = [i for i, _, t, _ in labelled if i >= 400 and (scores[i] >= 0.3) != t]
    assert len(wrong) <= 6
    kept = toxicity.accepted_rows(docs, model)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert len(ids & {i for i, _, t, _ in labelled if t and i >= 400}) <= 3
    assert len({i for i, _, t, _ in labelled if not t and i >= 400} - ids) <= 3


def test_quality_on_held_out_rows(spark, labelled):
    docs, labels = tables(spark, labelled)
    model = quality.train(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in quality.score_texts(docs, model).collect()}
    assert sum((scores[i] >= 0.7) != q for i, _, _, q in labelled if i >= 400) <= 6


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_odd_rows(spark, labelled, module, label):
    docs, labels = tables(spark, labelled)
    odd = documents(spark, ODD_TEXTS, ids=[1000, 1001, 1002, 1003, None, None, 1004, 1004, 1005], clash=True)
    more = spark.createDataFrame([(None, 1, 1), (5, None, None), (7, 9, 9), (1000, 1, 1), (0, 0, 0)], "doc_id bigint, quality int, toxic int")
    model = module.train(docs.unionByName(odd), labels.unionByName(more))
    scores = [r["score"] for r in module.score_texts(odd, model).collect()]
    assert len(scores) == 9 and all(0 <= s <= 1 for s in scores)
    assert module.score_texts(odd.limit(0), model).collect() == []
    one_class = module.train(docs, labels.where(f"{label} = 1"))
    assert {r["score"] for r in module.score_texts(odd, one_class).collect()} == {1.0}
    none = module.train(docs.limit(0), labels.limit(0))
    assert {r["score"] for r in module.score_texts(odd, none).collect()} == {0.0}


def test_a_missing_language_takes_the_pooled_threshold(spark, labelled):
    docs, labels = tables(spark, labelled)
    model = toxicity.train(docs.drop("lang"), labels)
    assert model.by_language == {} and model.thresholds([None, "xx"]).tolist() == [model.pooled] * 2
    assert toxicity.accepted_rows(docs.drop("lang"), model).count() > 300


def test_gradients_of_the_network():
    """The loss of the fixed sample falls, and the words of the planted stems carry the answer."""
    rng = random.Random(3)
    texts = [prose(rng, 30) + (" vexo" if i % 2 else "") for i in range(80)]
    sample = Sample(texts, np.array([i % 2 for i in range(80)]), [None] * 80, 0.5)
    model = toxicity.fit_model(sample)
    scores = model.scores(pa.array(["vexo", "vexoung", prose(rng, 50), ""]))
    assert scores[0] > 0.5 and scores[0] > scores[1] > scores[2] and scores[2] < 0.5 and scores[3] < 0.5


def test_calibration_restores_the_share():
    rng = np.random.default_rng(1)
    classes = np.repeat([0, 1], 500)
    raw = rng.normal(classes * 2.0, 1.0)
    slope, offset = calibrate(raw, classes, 0.1)
    p = sigmoid(slope * raw + offset)
    assert abs(np.average(p, weights=np.where(classes == 1, 0.1, 0.9)) - 0.1) < 0.02


def test_the_first_rows_by_hash(spark):
    from pyspark.sql import functions as F

    from hourloom.llm.training import first_by_hash

    rows = spark.range(5000).withColumnRenamed("id", "key")
    for k in (1, 100, 4000, 9000):
        want = {r["key"] for r in rows.orderBy(F.xxhash64("key"), "key").limit(k).collect()}
        assert {r["key"] for r in first_by_hash(rows, k).collect()} == want


def test_thresholds_do_not_follow_the_cap():
    rng = np.random.default_rng(3)
    toxic, clean = rng.beta(4, 3, 400), rng.beta(3, 4, 400)
    share = 400 / (400 + 8 * 400)

    def threshold(copies, share):
        classes = np.repeat([1, 0], [400, 400 * copies])
        scores = np.concatenate([toxic, np.tile(clean, copies)])
        return toxicity.best_threshold(scores, classes, class_weights(classes, share), 0.3)

    assert threshold(1, share) == threshold(2, share) == threshold(8, share)
    assert threshold(1, 0.5) < threshold(1, share) - 0.05


@pytest.mark.parametrize("ids", [[None] * 3000, [1] * 3000, list(range(3000)), list(range(900)), [5] * 40])
def test_sample_has_its_size_whatever_the_ids(spark, ids):
    rows = spark.createDataFrame([(i, f"text {n}") for n, i in enumerate(ids)], "id bigint, t string").repartition(3)
    got = [tuple(r) for r in training.first_by_hash(rows, 600).collect()]
    assert len(got) == len(set(got)) == min(600, len(ids))
    assert sorted(got, key=str) == sorted((tuple(r) for r in training.first_by_hash(rows.repartition(2), 600).collect()), key=str)


def test_sample_of_equal_rows_has_its_size(spark):
    rows = spark.range(5000).selectExpr("1 as id", "'same' as t")
    assert training.first_by_hash(rows, 600).count() == 600


def test_long_labelled_documents_are_fitted(spark):
    rng = random.Random(4)
    words = prose(rng, 6000)
    assert len(words) > 33_000
    rows = [(i, words + " vexo" if i % 2 else prose(rng, 40), i % 2) for i in range(60)]
    docs = documents(spark, [r[1] for r in rows], ids=[r[0] for r in rows])
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    assert model.net is not None
    low, high = model.scores(pa.array([prose(rng, 40), words + " vexo"]))
    assert low < 0.5 < high


def test_shards_hold_every_labelled_document(spark, labelled):
    docs, labels = tables(spark, labelled)
    more = spark.createDataFrame([(None, 1, 1), (5, None, None), (7, 9, 9), (0, 0, 0), (9_999, 1, 1), (3, 1, 0), (3, 1, 0)], "doc_id bigint, quality int, toxic int")
    marked = training.marked_labels(labels.unionByName(more), "toxic")
    rows = [r for r in training.labelled_shards(docs, marked, 7).collect()]
    home = [(r["id"], r["class"], r["t"]) for r in rows if r["home"]]
    assert sorted(home) == sorted({(i, t, text) for i, text, t, _ in labelled if i < 400} | {(0, 0, labelled[0][1])})
    assert all(len({r["shard"] for r in rows if r["class"] == c}) == 7 for c in (0, 1))
    assert len({(r["id"], r["class"], r["shard"]) for r in rows}) == len(rows)
    assert 60 < sum(r["held"] and r["home"] for r in rows) < 140


def test_toxicity_over_shards(spark, labelled):
    docs, labels = tables(spark, labelled)
    config = toxicity.NetConfig(shard=100)  # 320 labels of class 0: four shards
    model = toxicity.train(docs, labels, config)
    column = pa.array([text for _, text, _, _ in labelled], pa.large_string())
    scores = model.scores(column)
    assert sum((s >= 0.3) != t for s, (i, _, t, _) in zip(scores, labelled) if i >= 400) <= 8
    again = toxicity.train(docs.repartition(5), labels.repartition(3), config)
    np.testing.assert_array_equal(again.scores(column), scores)
    none = toxicity.train(docs.where("doc_id % 5 <> 0"), labels, config)  # no text of class 1
    assert none.net is None and none.offset == 0.2


def test_every_document_to_be_fitted_is_in_a_batch():
    classes = np.array([1] * 10 + [0] * 900)
    net = toxicity.TextNet(np.arange(3), toxicity.NetConfig())
    for due in (np.arange(910), np.arange(0, 910, 7)):
        drawn = list(net.batches(classes, 5, np.random.default_rng(0), due))
        assert set(due) <= set(np.concatenate(drawn))
        assert all(len(own) == 32 and classes[own].sum() == 16 for own in drawn)


def test_the_best_threshold_equals_trying_all():
    rng = np.random.default_rng(8)
    for n in (2, 5, 60, 300):
        classes = np.concatenate([[0, 1], rng.integers(0, 2, n - 2)])
        scores, weights = np.round(rng.beta(2 + classes, 3), 2), class_weights(classes, 0.2)
        options = np.unique(np.concatenate([[0.3], (np.unique(scores)[1:] + np.unique(scores)[:-1]) / 2]))

        def f1(t):
            hit = scores >= t
            return 2 * weights[hit & (classes == 1)].sum() / (weights[hit].sum() + weights[classes == 1].sum())

        assert toxicity.best_threshold(scores, classes, weights, 0.3) == max(options, key=lambda t: (round(f1(t), 9), -abs(t - 0.3)))


def test_the_filter_of_ids_drops_no_marked_row_and_most_others(spark):
    marked = spark.range(0, 4000, 2).selectExpr("id - 1000 as id", "1 as class")
    source = spark.range(-2000, 6000).selectExpr("if(id = 77, null, id) as id", "'text' as t", "'en' as l")
    kept = {r["id"] for r in training.perhaps_marked(source, marked).collect()}
    wanted = {r["id"] for r in marked.collect()}
    assert wanted <= kept and None not in kept and len(kept - wanted) < 20
