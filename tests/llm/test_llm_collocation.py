"""Collocations against plain counting, with few and many shards and with saturated filters."""

import random
import re
from collections import Counter

import pytest
from llm_helpers import DOC

from hourloom.llm import collocation


def plain_counts(rows):
    counts, sizes = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    return counts, sizes


def plain_collocations(rows, threshold, top):
    counts, sizes = plain_counts(rows)
    frequent = {p: n for p, n in counts.items() if n >= threshold}
    explained = set()
    for (lang, words), n in frequent.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                if 100 * n >= 80 * frequent[lang, words[i : i + k]]:
                    explained.add((lang, words[i : i + k]))
    out = {}
    for (lang, words), a in frequent.items():
        if len(words) > 1 and (lang, words) not in explained:
            cuts = [(frequent[lang, words[:k]], frequent[lang, words[k:]], k) for k in range(1, len(words))]
            score, _, left, right = min((2_000_000 * a // (left + right), k, left, right) for left, right, k in cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    rows = []
    for lang, found in out.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(rows)


def random_rows(seed, texts):
    rng = random.Random(seed)
    vocabulary = ["Ab", "b", "cé", "日本", "d d", "ee", "f"] + [f"w{i}" for i in range(40)]
    rows = []
    for _ in range(texts):
        words = [rng.choice(vocabulary[:7] if rng.random() < 0.7 else vocabulary) + rng.choice([" "] * 12 + ["  ", "\t", ".", ", ", "\n", "\x0b"]) for _ in range(rng.randrange(60))]
        rows.append((rng.choice(["en", "de", None, "", "a b,c"]), "".join(words)))
    return rows + [("en", None), ("en", ""), ("en", " ,.\n"), (None, None), ("en", "Ab b cé " * 300)] + [("de", "same words again here")] * 40


def table(spark, rows):
    full = [(i if i % 7 else None, text, lang, "src", None, 1, "x", 2) for i, (lang, text) in enumerate(rows)]
    return spark.createDataFrame(full, DOC + ", n long, phrase string, words int").repartition(3)


def found(spark, rows, threshold, top=2000, **options):
    counts = collocation.count_phrases(table(spark, rows), threshold=threshold, **options)
    return sorted(tuple(r) for r in collocation.collocations(counts, top).collect())


@pytest.mark.parametrize(("shards", "filter_bytes"), [(1, 1 << 23), (2, 1 << 23), (3, 16), (5, 1 << 23)])
def test_matches_plain_counting(spark, shards, filter_bytes):
    rows = random_rows(shards, 400)
    want = plain_collocations(rows, 8, 50)
    assert len(want) > 30 and any(" " in r[2] and len(r[2].split(" ")) == 4 for r in want)
    assert found(spark, rows, 8, 50, shards=shards, filter_bytes=filter_bytes) == want


def test_all_frequent_phrases_are_counted(spark):
    rows = random_rows(9, 60)
    counts, sizes = plain_counts(rows)
    got = {(r["lang"], r["words"], r["phrase"]): r["n"] for r in collocation.count_phrases(table(spark, rows), threshold=7).collect()}
    want = {(lang, len(words), " ".join(words)): n for (lang, words), n in counts.items() if n >= 7}
    assert got == want | {(lang, 0, ""): n for lang, n in sizes.items()}


def test_ties_and_rank_follow_the_contract(spark):
    rows = [("en", "b a. c b. a c. " * 30)]
    got = found(spark, rows, 30)
    assert got == plain_collocations(rows, 30, 10) and [r[2] for r in got] == ["a c", "b a", "c b"]


def test_empty_tables(spark):
    assert found(spark, [("en", None), (None, "")], 1) == []
    counts = collocation.count_phrases(table(spark, [("en", "a")]).limit(0))
    assert collocation.collocations(counts).collect() == []


def test_products_beyond_64_bits(spark):
    big = 8_000_000_000_000_000_000
    rows = [("en", "", 0, big), ("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "a b", 2, big - 2)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, words int, n long")
    assert [tuple(r) for r in collocation.collocations(counts).collect()] == [("en", 1, "a b", big - 2, big, big - 1, big, 2_000_000 * (big - 2) // (2 * big - 1))]


def slice_batch(texts):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], names=["lang", "text"])


def test_a_slice_is_counted_in_little_memory():
    """4 MB of text with all phrases active: batches stay small and arrays far below what a number per letter would take."""
    import tracemalloc

    rng = random.Random(2)
    batch = slice_batch([" ".join(str(rng.randrange(10**6)) for _ in range(300)) for _ in range(2000)])
    assert batch.nbytes > 4_000_000
    tracemalloc.start()
    rows = [b.num_rows for b in collocation._count([batch], {size: None for size in (1, 2, 3, 4)})]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(rows) > 2_000_000 and max(rows) <= collocation.BATCH_PHRASES
    assert peak < 150e6


def test_words_are_the_same_in_any_block(monkeypatch):
    rng = random.Random(3)
    column = slice_batch(["".join(rng.choice("aB é\t.,\n") for _ in range(rng.randrange(90))) for _ in range(300)] + [None, "x" * 5000]).column(1)
    whole = collocation.Pieces(column)
    monkeypatch.setattr(collocation, "HASH_BYTES", 64)
    assert (whole.hashes() == collocation.Pieces(column).hashes()).all() and len(set(whole.hashes().tolist())) > 100


@pytest.mark.parametrize("counters", [1, 64, 1 << 24])
def test_pair_bounds_lose_nothing(spark, counters):
    """Few counters that have all filled up, and more: the same phrases as by plain counting."""
    rows = random_rows(12, 300)
    assert found(spark, rows, 8, 50, counters=counters) == plain_collocations(rows, 8, 50)
    assert found(spark, rows, 300, 50, counters=counters) == plain_collocations(rows, 300, 50)


def test_rare_pairs_of_frequent_words_are_not_passed_on(spark):
    """Random pairs of 200 frequent words, nearly all rare: after the first step hardly any of them is written."""
    rng = random.Random(5)
    rows = [("en", " ".join(f"w{rng.randrange(200)}" for _ in range(60))) for _ in range(400)] + [("en", "w1 w2")] * 40
    written, real = [], collocation.materialize

    def counted(df, name):
        out = real(df, name)
        if name == "counted":
            written.append(out.where("words = 2").count())
        return out

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(collocation, "materialize", counted)
        got = found(spark, rows, 30)
    assert got == plain_collocations(rows, 30, 2000) and [r[2] for r in got] == ["w1 w2"]
    assert max(written) < 2000
