import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import ODD_TEXTS, documents

from hourloom.llm import subword

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return subword.MergeTokenizer(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="abcdehinorst  \n\t.,▁é日😀", max_size=200))
def test_same_ids_and_text_as_the_library(both, text):
    own, library = both
    ids = own.encode(text)
    assert ids == library.encode(text)
    assert own.decode(ids) == library.decode(ids)


def test_runs_of_spaces(both):
    own, library = both
    for n in [*range(60), 1000]:
        for text in (" " * n, "a" + " " * n + "b", " " * n + "\n" + " " * n + "the"):
            assert own.encode(text) == library.encode(text)
            assert own.decode(own.encode(text)) == library.decode(library.encode(text))


def test_a_small_memory_changes_nothing(both):
    text = "the quick brown fox jumps over the lazy dog and the other quick dogs " * 3
    assert subword.MergeTokenizer(MODEL, memory=4).encode(text) == both[1].encode(text)


def test_tables(spark, both):
    texts = [*ODD_TEXTS, "x" * 100_000]
    docs = documents(spark, texts, ids=[*range(9), None], clash=True)
    rows = subword.encode_texts(docs, MODEL).collect()
    want = sorted((i if i is not None else -1, both[1].encode(t or ""), both[1].decode(both[1].encode(t or ""))) for i, t in zip([*range(9), None], texts))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["ids"], r["decoded"]) for r in rows) == want
    assert subword.encode_texts(documents(spark, []), MODEL).collect() == []
