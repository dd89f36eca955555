"""The stages over a small fixture, against what was planted, and the registered queries' shapes."""

import random

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from llm_helpers import documents

import corpus_pipeline
from hourloom.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


def prose(rng, n):
    return " ".join("".join(rng.choice(["on", "the", "er", "ti", "an", "re", "sh", "ly"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    folder = str(tmp_path_factory.mktemp("corpus"))
    items = [(i, prose(rng, 30)) for i in range(5)]
    texts = {i: prose(rng, 80) for i in range(300)}
    toxic = set(range(0, 300, 6))
    for i in toxic:
        words = texts[i].split()
        for _ in range(3):
            words.insert(rng.randrange(80), rng.choice(["vexoung", "grumbia", "vexos", "grumben"]))
        texts[i] = " ".join(words)
    copies = {301: 1, 302: 1, 303: 7}
    texts |= {c: texts[o] for c, o in copies.items()}
    leaks = {11, 13, 17}
    for n, i in enumerate(sorted(leaks)):
        texts[i] = texts[i] + " " + items[n][1] + " " + prose(rng, 10)
    texts[19] += " mail me at some.one@mail.example.com or 10.20.30.40 now"
    documents(spark, list(texts.values()), ids=list(texts)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, 1, int(i in toxic)) for i in range(300)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, texts, toxic, set(copies), leaks


def test_decisions_take_effect(spark, corpus):
    folder, texts, toxic, copies, leaks = corpus
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    want = set(texts) - toxic - copies - leaks
    assert len(want - set(rows)) <= 2 and len(set(rows) - want) <= 2
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.VOCABULARY))
    redacted = texts[19].replace("some.one@mail.example.com", "<EMAIL>").replace("10.20.30.40", "<IP>")
    for i, r in rows.items():
        assert r["text"] == (redacted if i == 19 else texts[i])
        assert r["ids"] == library.encode(r["text"]) and r["n_tokens"] == len(r["ids"])


def test_all_but_the_last_stage_keep_the_columns(spark, corpus):
    folder = corpus[0]
    docs = corpus_pipeline.read(spark, folder, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).schema.simpleString() == docs.schema.simpleString()


def test_empty_documents(spark, corpus):
    docs = corpus_pipeline.read(spark, corpus[0], "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, corpus[0]).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    result = QUERIES[name](spark, SF_DIR)
    columns = sorted(result.columns)
    expected = connection.execute(ORACLES[name])
    place = [[d[0] for d in expected.description].index(c) for c in columns]
    want = sorted(repr([r[i] for i in place]) for r in expected.fetchall())
    assert sorted(repr([r[c] for c in columns]) for r in result.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"pipeline"}))
def test_other_queries_answer_every_document(spark, name):
    docs = corpus_pipeline.read(spark, SF_DIR, "documents").count()
    got = QUERIES[name](spark, SF_DIR)
    assert "doc_id" in got.columns
    assert got.count() == docs or name == "op2_decontamination"
