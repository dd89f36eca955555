import random

from llm_helpers import ODD_TEXTS, documents

from hourloom.llm import decontaminate as dc


def words(rng, n):
    return [rng.choice("ab") + str(rng.randrange(400)) for _ in range(n)]


def plain_matches(docs, items):
    """Every window of every document against every item of its size."""
    out = {}
    for d, text in docs:
        mine = (text or "").lower().split()
        for i, item in items:
            theirs = (item or "").lower().split()
            n = min(len(mine), len(theirs))
            k = min(5, len(theirs))
            if not theirs or n < k:
                continue
            found = [
                (-dc.weighted_jaccard([w.encode() for w in mine[s : s + n]], [w.encode() for w in theirs], k), s) for s in range(len(mine) - n + 1)
            ]
            likeness, start = min(found)
            if -likeness >= 0.8:
                out[d, i] = (round(-likeness, 9), start)
    return out


def test_windows_match_brute_force(spark):
    rng = random.Random(3)
    items = [(i, " ".join(words(rng, rng.randrange(8, 50)))) for i in range(12)] + [(50, "one two"), (51, None), (52, " ")]
    docs = []
    for d in range(60):
        w = words(rng, rng.randrange(0, 120))
        if d % 2:
            own = rng.choice(items[:12])[1].split()
            for _ in range(d % 3):
                own[rng.randrange(len(own))] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = own
        if d == 7:
            w[3:3] = ["ONE", "two"]
        docs.append((d, " ".join(w)))
    got = dc.contaminated(documents(spark, [t for _, t in docs], clash=True), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = plain_matches(docs, items)
    assert {(r["doc_id"], r["item_id"]): (round(r["similarity"], 9), r["word_start"]) for r in got} == want
    assert len(got) == len(want) > 10 and (7, 50) in want


def test_blocks_find_all_within_radius():
    import numpy as np

    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**63, 40, dtype=np.uint64)
    asked = prints[rng.integers(0, 40, 100)] ^ (np.uint64(1) << rng.integers(0, 64, 100, dtype=np.uint64))
    for radius in (0, 1, 7, 18):
        want = {(q, k) for q in range(100) for k in range(40) if int(asked[q] ^ prints[k]).bit_count() <= radius}
        assert {(q, k) for q, k, _ in dc.HammingBlocks(prints, radius).within(asked)} == want


def test_item_blocks_change_nothing(spark):
    rng = random.Random(5)
    items = [(i, " ".join(words(rng, 20))) for i in range(20)]
    docs = documents(spark, [f"lead {items[i][1]} tail" for i in range(0, 20, 3)])
    table = spark.createDataFrame(items, "item_id bigint, text string")
    whole = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(docs, table).collect()}
    parts = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(docs, table, item_bytes=300).collect()}
    assert whole == parts == {(n, i) for n, i in enumerate(range(0, 20, 3))}
    assert dc.clean_rows(docs, table, item_bytes=300).count() == 0


def test_odd_rows(spark):
    item = "a passage of more than five words that is shared"
    docs = documents(spark, [*ODD_TEXTS, item, item, f"{'x ' * 5000}{item}"], ids=[*range(9), None, None, 30], clash=True)
    table = spark.createDataFrame([(1, item), (1, item), (None, item)], "item_id bigint, text string")
    assert dc.contaminated(docs, table).count() == 9
    kept = dc.clean_rows(docs, table)
    assert kept.columns == docs.columns and kept.count() == 9
    nothing = table.limit(0)
    assert dc.contaminated(docs, nothing).count() == 0 and dc.clean_rows(docs, nothing).count() == 12
    assert dc.contaminated(documents(spark, []), table).count() == 0
