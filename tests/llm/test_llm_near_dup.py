import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import ODD_TEXTS, documents

from hourloom.llm import near_dup
from hourloom.llm.components import connected_components


def plain_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).split() if (text or "").isascii() else (text or "").encode().lower().decode().split()
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes) > 0)


def plain_components(prints):
    """Least place reachable over links of 3 or fewer bits."""
    group = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if group[j] < group[i] and (a ^ b).bit_count() <= 3:
                    group[i], changed = group[j], True
    return group


def unsigned(x):
    return x % (1 << 64)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**64 - 1), max_size=600), max_size=6))
def test_majority_bits(rows):
    flat = np.array([h for r in rows for h in r], dtype=np.uint64)
    got = near_dup.majority_bits(flat, np.array([len(r) for r in rows], dtype=np.int64))
    want = [sum(1 << b for b in range(64) if sum(h >> b & 1 for h in r) * 2 > len(r) > 0) for r in rows]
    assert got.tolist() == want


def test_masks_share_out_all_bits():
    for masks in near_dup.shard_masks():
        assert sum(masks) == 2**64 - 1 and len(masks) == 4
    free = 2**64 - 1
    worst = [free]
    for masks in near_dup.shard_masks():
        worst = [w & ~m for w in worst for m in masks]
    assert max(w.bit_count() for w in worst) <= 17


def test_bk_tree_finds_all_within_radius():
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = list({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) for b in base for _ in range(20)})
    tree = near_dup.BKTree()
    for v in values:
        tree.add(v)
        tree.add(v)
    for v in values:
        assert sorted(tree.near(v, 3)) == sorted(x for x in values if (x ^ v).bit_count() <= 3)


@pytest.mark.parametrize("limit", [2048, 4])
def test_components_match_all_pairs(spark, limit):
    rng = random.Random(7)
    prints = []
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 9)):
            prints.append(x)
            for _ in range(rng.randrange(4)):
                x ^= 1 << rng.randrange(64)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = near_dup.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp bigint"), 3, limit)
    roots = {r["node"]: r["root"] for r in connected_components(links, "a", "b").collect()}
    group = plain_components(prints)
    named = [roots.get(p, p) for p in signed]
    assert len(set(named)) == len(set(group))
    assert len(set(zip(named, group))) == len(set(group))


def test_odd_texts(spark):
    docs = documents(spark, ODD_TEXTS, ids=[5, 4, 3, 10, 11, 12, 20, 20, None], clash=True)
    rows = near_dup.near_duplicates(docs).collect()
    got = {(r["doc_id"], unsigned(r["fp"])): r["component_id"] for r in rows}
    want = {(i, plain_fingerprint(t)) for i, t in zip([5, 4, 3, 10, 11, 12, 20, 20, None], ODD_TEXTS)}
    assert set(got) == want and len(rows) == len(ODD_TEXTS)
    assert got[5, 0] == got[4, 0] == got[3, 0] == 3
    assert got[None, plain_fingerprint(ODD_TEXTS[-1])] is None


def test_empty_table(spark):
    assert near_dup.near_duplicates(documents(spark, [])).collect() == []
    assert near_dup.keep_one_per_group(documents(spark, [])).collect() == []


def test_one_row_of_each_group_stays(spark):
    docs = documents(spark, ["x y z w", "x y z w", "other words stand here", None, "", None], ids=[2, 1, 3, None, 8, 8], clash=True)
    kept = near_dup.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 3, 8]
