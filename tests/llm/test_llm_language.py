"""Cross-parsing against plain substring search, and language on held-out rows."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import ODD_TEXTS, documents
from pyspark.sql import functions as F

from hourloom.llm import language
from hourloom.llm.training import fold


def plain_letters(text):
    folded = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
    return " ".join(folded.split(" ")).strip() if folded.strip() else ""


def plain_parse(known, text, block):
    """Greedy longest phrases that `known` holds, restarted every `block` letters."""
    phrases = 0
    for low in range(0, len(text), block):
        part, at = text[low : low + block], 0
        while at < len(part):
            size = 1
            while at + size < len(part) and part[at : at + size + 1] in known:
                size += 1
            at, phrases = at + size, phrases + 1
    return phrases


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aab ", min_size=1, max_size=60), min_size=1, max_size=3), st.lists(st.text(alphabet="aab xé", max_size=50), min_size=1, max_size=5))
def test_parsing_matches_substring_search(known, values):
    alphabet = sorted(set("".join(known)))
    model = language.LanguageModel(tuple(map(str, range(len(known)))), tuple(known), "".join(alphabet))
    for block in (7, 2048):
        points, bounds = language.letters(values)
        got = language.phrase_counts(model.parsers(), model.codes(points), bounds, block)
        text = points.tobytes().decode("utf-32-le")
        for i in range(len(values)):
            assert got[i].tolist() == [plain_parse(k, text[bounds[i] : bounds[i + 1]], block) for k in known]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB éßI1.\n日\U0001f600", max_size=12), max_size=5))
def test_letters_keep_words_apart(values):
    points, bounds = language.letters(values)
    text = points.tobytes().decode("utf-32-le")
    for i, t in enumerate(values):
        assert text[bounds[i] : bounds[i + 1]] == " ".join(plain_letters(t).split())


def sentences(seed, vowels, number):
    rng = random.Random(seed)
    words = ["".join(rng.choice("bcdfg") + rng.choice(vowels) for _ in range(rng.randrange(1, 4))) for _ in range(40)]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(5, 40))) + "." for _ in range(number)]


def test_identify_on_held_out_rows(spark):
    rows = [(t, "xa") for t in sentences(1, "aei", 60)] + [(t, "yo") for t in sentences(2, "aou", 60)] + [("nothing known", None)] * 5
    docs = documents(spark, [t for t, _ in rows], clash=True).drop("lang").join(
        spark.createDataFrame([(i, lang) for i, (_, lang) in enumerate(rows)], "doc_id bigint, lang string"), "doc_id"
    )
    model = language.train(docs, fold("doc_id", 5) != 0)
    assert model.names == ("xa", "yo")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got.values())
    assert all(got[i][0] == lang and got[i][1] > 0.5 for i, (_, lang) in enumerate(rows) if lang)


def test_odd_texts_and_empty_tables(spark):
    docs = documents(spark, [*ODD_TEXTS, "12 .,"], clash=True)
    untrained = language.train(docs.limit(0), F.lit(True))
    assert [(r["lang_pred"], r["score"]) for r in language.identify(docs, untrained).collect()] == [("und", 0.0)] * (len(ODD_TEXTS) + 1)
    single = language.train(docs, F.lit(True))
    got = [(r["lang_pred"], r["score"]) for r in language.identify(docs, single).orderBy("doc_id").collect()]
    assert got == [("und", 0.0)] * 3 + [("en", 1.0)] * 6 + [("und", 0.0)]
    assert language.identify(docs.limit(0), single).collect() == []


def test_tables_stay_bounded():
    rows = [{"lang": f"l{i:02}", "text": t, "order": i} for i in range(30) for t in sentences(i, "aeiou", 8)]
    bound = language.LanguageBound(table_entries=1 << 18)
    assert language.fit_model(rows, bound).parsers().table.size <= 1 << 18


@pytest.mark.parametrize("seed", [1, 2])
def test_whole_text_counts(seed):
    """The end of a long text decides if its beginning does not."""
    model = language.fit_model([{"lang": n, "text": t, "order": i} for n, v in (("xa", "aei"), ("yo", "aou")) for i, t in enumerate(sentences(seed, v, 50))])
    texts = ["bcd " * 3000 + " ".join(sentences(seed, v, 2000)) for v in ("aei", "aou")]
    names, scores = language.judge(model, texts)
    assert names == ["xa", "yo"] and np.all(scores > 0.5)


def test_held_out_accuracy_on_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs, language.train(docs, fold("doc_id", 5) != 0)).join(docs.select("doc_id", "lang"), "doc_id")
    held = [r for r in found.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 150 and np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97
