import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from llm_helpers import ODD_TEXTS, documents
from pyspark.sql import functions as F

from hourloom.llm import lattice
from hourloom.llm.training import fold

PIECES = ["▁", "a", "b", "c", "▁a", "ab", "bc", "abc", "▁ab", "ca"]


@pytest.fixture(scope="module")
def small():
    return lattice.Lattice(PIECES, -np.arange(len(PIECES), dtype=float))


def segmentations(text):
    if not text:
        yield []
    for k in range(1, len(text) + 1):
        if k == 1 or text[:k] in PIECES:
            for rest in segmentations(text[k:]):
                yield [text[:k], *rest]


def weight(model, piece):
    if piece in model.place:
        return model.log_weight[model.place[piece]]
    return len(piece.encode()) * (model.log_weight[len(PIECES)] - math.log(256))


def test_sum_over_all_segmentations(small):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 8))) for _ in range(60)]
    got, use = small.log10(words), small.expected(words, np.arange(60))
    want_use = np.zeros_like(use)
    for i, w in enumerate(words):
        ways = [(s, sum(weight(small, p) for p in s)) for s in segmentations("▁" + w)]
        whole = np.logaddexp.reduce([v for _, v in ways])
        assert got[i] == pytest.approx(whole / math.log(10), abs=1e-9)
        for s, v in ways:
            for p in s:
                want_use[small.place.get(p, len(PIECES))] += math.exp(v - whole) * i * (1 if p in small.place else len(p.encode()))
    assert np.allclose(use, want_use)


def test_long_words_agree(small, monkeypatch):
    words = ["abcab" * 3, "écab", "c" * 40]
    whole, use = small.log10(words), small.expected(words, np.ones(3))
    monkeypatch.setattr(lattice, "_LONG", 2)
    assert np.allclose(small.log10(words), whole) and np.allclose(small.expected(words, np.ones(3)), use)


def test_learning_raises_the_likelihood(small):
    words, counts = ["abc", "ca"], np.array([50, 1])
    before = small.log10(words) @ counts
    assert small.learned(small.expected(words, counts)).log10(words) @ counts > before


def plain_base(texts, held):
    split = [(t or "").encode().lower().split() + [None] for t in texts]
    counts = Counter(w for s, h in zip(split, held) if not h for w in s)
    total, kinds = counts.total(), len(counts)
    return [
        (len(s), sum(counts[w] > 0 for w in s), total, sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in s)) for s in split
    ]


@pytest.mark.parametrize("block_bytes", [1 << 25, 200])
def test_tables_match_brute_force(spark, block_bytes):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "The", "of", "abc", "Zoë", f"w{rng.randrange(50)}"]) for _ in range(rng.randrange(60))) for _ in range(80)]
    texts += ODD_TEXTS
    docs = documents(spark, texts, clash=True).repartition(3)
    model = lattice.Lattice.from_model(public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in lattice.score_texts(docs, model, fold("doc_id", 5) == 1, block_bytes).collect()}
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    learned = model
    counts = Counter(w for t, h in zip(texts, held) if not h for w in (t or "").encode().lower().split())
    words = [w.decode() for w in counts]
    for _ in range(model.config.rounds):
        use = learned.expected(words, np.array(list(counts.values())))
        use[-1] = held.count(False)
        learned = learned.learned(use)
    end = learned.log_weight[-1] / math.log(10)
    for i, (n, known, total, base) in enumerate(plain_base(texts, held)):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, held[i])
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        own = [w.decode() for w in (texts[i] or "").encode().lower().split()]
        assert r["score"] == pytest.approx((learned.log10(own).sum() if own else 0.0) + end, rel=1e-9)


def test_odd_tables(spark):
    model = lattice.Lattice(PIECES, -np.arange(len(PIECES), dtype=float))
    assert lattice.score_texts(documents(spark, []), model, F.lit(False)).collect() == []
    rows = lattice.score_texts(documents(spark, ["ab", "ab", None], ids=[None, None, 1]), model, F.lit(True)).collect()
    assert len(rows) == 3 and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0.0 for r in rows if r["n_tokens"] == 1)
