"""Near copies against brute force over all pairs of edited copies."""

import random

import pytest
from llm_helpers import documents

from hourloom.llm import copies, near_dup


def plain_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(texts):
    sets = [plain_set(t) for t in texts]
    group = list(range(len(texts)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    pairs = 0
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                pairs += 1
                a, b = sorted((top(i), top(j)))
                group[b] = a
    return [top(i) for i in range(len(texts))], pairs


def edited_copies(seed, bases, copies_of_each):
    rng = random.Random(seed)
    out = []
    for _ in range(bases):
        words = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(300)) for _ in range(rng.choice([3, 8, 60, 120, 400]))]
        out.append(" ".join(words))
        for _ in range(copies_of_each):
            own = list(words)
            for _ in range(rng.randrange(1 + len(own) // 30)):
                own[rng.randrange(len(own))] = "edit" + str(rng.randrange(10_000))
            out.append(" ".join(own).upper() if rng.random() < 0.2 else " ".join(own))
    rng.shuffle(out)
    return out


def kept_ids(spark, texts, **bounds):
    docs = documents(spark, texts, clash=True).repartition(3)
    return sorted(r["doc_id"] for r in copies.least_rows(docs, ["doc_id"], **bounds).collect())


@pytest.mark.parametrize("bounds", [{}, {"pairs_per_member": 0, "star_rounds": 2}, {"star_rounds": 0}])
def test_groups_match_brute_force(spark, bounds):
    texts = edited_copies(3, 40, 6)
    groups, pairs = plain_groups(texts)
    assert pairs > 100
    assert kept_ids(spark, texts, **bounds) == sorted(set(groups))


def test_stage_keeps_one_of_each_group(spark):
    texts = edited_copies(4, 25, 5)
    kept = near_dup.keep_one_per_group(documents(spark, texts)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(plain_groups(texts)[0]))


def test_rows_of_a_repeated_id_are_rows_of_their_own(spark):
    a, b, c = ("one two three four five six", "quite other words stand in here", "a third text without any id")
    rows = [(5, a), (3, a), (5, b), (7, b), (None, c), (None, c.upper()), (None, a), (4, ""), (4, None)]
    docs = documents(spark, [t for _, t in rows], ids=[i for i, _ in rows], clash=True)
    kept = [(r["doc_id"], (r["text"] or "").lower()) for r in near_dup.keep_one_per_group(docs).collect()]
    assert sorted(kept, key=str) == sorted([(3, a), (5, b), (None, c), (4, "")], key=str)


def template_texts(number, common=60, own=18):
    rng = random.Random(8)
    frame = [f"frame{i}" for i in range(common)]
    return [" ".join(frame[:40] + [f"own{n}x{rng.randrange(1 << 30)}" for _ in range(own)] + frame[40:]) for n in range(number)]


def test_texts_on_one_template_are_not_compared(spark, monkeypatch):
    """1,600 rows that share 60 of 78 words, none a near copy: the pairs that are compared stay linear."""
    compared, real = [], copies.similar_pairs

    def counted(pairs, sets, similarity):
        compared.append(pairs.count())
        return real(pairs, sets, similarity)

    monkeypatch.setattr(copies, "similar_pairs", counted)
    texts = template_texts(1600)
    assert len(kept_ids(spark, texts)) == 1600
    assert sum(compared) < 20 * 1600


def test_short_texts_around_one_passage_are_not_compared(spark, monkeypatch):
    """400 short texts that share 50 of their 61 shingles, none a near copy: they meet on the passage, their marks tell them apart."""
    compared, real = [], copies.similar_pairs

    def counted(pairs, sets, similarity):
        compared.append(pairs.count())
        return real(pairs, sets, similarity)

    monkeypatch.setattr(copies, "similar_pairs", counted)
    texts = template_texts(400, common=58, own=7)
    groups, _ = plain_groups(texts)
    assert sorted(set(groups)) == list(range(400))
    assert kept_ids(spark, texts) == list(range(400))
    assert sum(compared) < 400


def test_long_texts_that_share_much_give_no_links_in_later_rounds(spark, monkeypatch):
    """120 long texts at about 0.7, none a near copy: their shards stay open, but their wide marks leave no pair over."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(1200)]
    texts = []
    for n in range(120):
        own = list(base)
        for place in rng.sample(range(len(own)), 22):
            own[place] = f"own{n}x{place}"
        texts.append(" ".join(own))
    assert len(set(plain_groups(texts)[0])) == len(texts)
    rows, real = [], copies.shard_links

    def counted(*args, **bounds):
        found = real(*args, **bounds)
        rows.append(found.count())
        return found

    monkeypatch.setattr(copies, "shard_links", counted)
    assert kept_ids(spark, texts) == list(range(len(texts)))
    assert len(rows) > 1 and sum(rows[1:]) < len(texts)


def test_wide_marks_keep_every_similar_pair_of_a_shard():
    """With wide marks a shard passes on all pairs at 0.8 that it passes on without them, by both kinds of tree."""
    import numpy as np

    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 900, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(900) < 1 - rng.choice([0.03, 0.1, 0.2]), base, rng.integers(0, 1 << 62, 900, dtype=np.uint64))) for _ in range(60)]
    known, roots = copies.traits(sets), np.arange(len(sets))
    wide, none = copies.parity_marks(sets, copies.WIDE).view(np.uint64), np.zeros((len(sets), 0), dtype=np.uint64)
    similar = {(i, j) for j in range(60) for i in range(j) if copies.jaccard(sets[i], sets[j]) >= 0.8}
    for links in (lambda w: zip(*copies.tree_links(known, w, roots, 0.8, None)[:2]), lambda w: copies.small_tree_links(known, w, roots, 0.8)):
        every, left = ({tuple(map(int, p)) for p in links(w)} for w in (none, wide))
        assert similar and similar & every <= left < every


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.95])
def test_prefixes_of_similar_sets_meet(similarity):
    """Sets at least that similar share a prefix key that the size and place bounds let pass, whatever the sketch says."""
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(400):
        base = rng.integers(0, 1 << 62, rng.integers(1, 60), dtype=np.uint64)
        pair = [np.unique(np.concatenate([base[rng.random(len(base)) < 0.95], rng.integers(0, 1 << 62, rng.integers(0, 4), dtype=np.uint64)])) for _ in range(2)]
        if not all(map(len, pair)) or copies.jaccard(*pair) < similarity:
            continue
        sketch = rng.integers(0, 5, 64).astype(np.uint16)
        x, y = (copies.prefix_keys(s, sketch, similarity).tolist() for s in pair)
        n, m = map(len, pair)
        least = similarity / (1 + similarity) * (n + m) - 1e-6
        meeting = [k for k in x if k in y]
        places = [(x.index(k), y.index(k)) for k in meeting]
        assert min(n, m) >= similarity * max(n, m) - 1e-9
        assert meeting and all(min(i, j) + min(n - i, m - j) >= least for i, j in places)
        a, b = copies.parity_marks(pair).view(np.uint64)
        apart = sum(int(v).bit_count() for v in a ^ b)
        assert apart <= len(set(pair[0].tolist()) ^ set(pair[1].tolist())) <= n + m - 2 * least


def test_clashing_row_column_is_kept(spark):
    docs = documents(spark, ["same text here", "SAME text here", "other"]).selectExpr("*", "doc_id * 10 as __row", "'x' as __row_")
    kept = near_dup.keep_one_per_group(docs)
    assert sorted((r["doc_id"], r["__row"], r["__row_"]) for r in kept.collect()) == [(0, 0, "x"), (2, 20, "x")]


def test_all_pairs_come_from_trees_over_fingerprints(spark, monkeypatch):
    """Every pair that is decided was found within the radius by a BK-tree; without trees there is no pair."""
    monkeypatch.setattr(copies, "RADIUS", -1)
    texts = edited_copies(3, 5, 4)
    different = {frozenset(plain_set(t)) for t in texts}
    assert len(kept_ids(spark, texts)) == len(different)


def test_shards_over_the_limit_are_dealt_on(spark):
    texts = edited_copies(5, 12, 8) + template_texts(60)
    groups, _ = plain_groups(texts)
    assert kept_ids(spark, texts, shard_limit=3) == sorted(set(groups))
    assert kept_ids(spark, texts, shard_limit=3, pairs_per_member=0, star_rounds=3) == sorted(set(groups))


@pytest.mark.parametrize("leaf", [1, 3, 256])
def test_batch_trees_find_all_pairs_and_span_their_groups(leaf):
    import numpy as np

    from hourloom.llm import hamming

    rng = np.random.default_rng(leaf)
    for _ in range(60):
        values = rng.integers(0, 1 << 62, 4).astype(np.uint64)[rng.integers(0, 4, rng.integers(2, 60))]
        for bit in range(6):
            values ^= np.uint64(1) << rng.integers(0, 64, len(values)).astype(np.uint64)
        radius = int(rng.integers(0, 12))
        want = [(i, j) for j in range(len(values)) for i in range(j) if int(values[i] ^ values[j]).bit_count() <= radius]
        blocks = hamming.tree_pairs(values, radius, np.arange(len(values)), leaf)
        assert sorted((int(a), int(b)) for i, j in blocks for a, b in zip(i, j)) == sorted(want)
        groups, top = hamming.Groups(np.arange(len(values))), list(range(len(values)))
        links = [groups.spanning(i, j).size for i, j in hamming.tree_pairs(values, radius, groups.label, leaf)]
        for _ in values:
            for i, j in want:
                top[i] = top[j] = min(top[i], top[j])
        assert sum(links) == len(values) - len(set(top))
        assert len(set(zip(top, groups.label.tolist()))) == len(set(top)) == len(set(groups.label.tolist()))
