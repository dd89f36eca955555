"""Conversation repair against a search over all edit sequences, with chunks of one row and more."""

import hashlib
import heapq
import random
import re

import pytest

from hourloom.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def plain_rows(rows):
    """Rows in order with their first fault."""
    fixed = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    fixed.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:64], hashlib.sha256(r[3].encode()).hexdigest()))
    seen, out = set(), []
    for _, turn, role, text in fixed:
        shown = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def plain_repair(rows):
    """Cheapest edits by uniform-cost search over (cost, audit); at most two inserts in a row."""
    rows = plain_rows(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, roles, out = heapq.heappop(heap)
        if at == len(rows) and LEGAL.fullmatch(roles):
            break
        key = (at, roles[-1:], len(roles) > 0, audit)
        if key in done:
            continue
        done.add(key)
        grown = [("I", 2, at, r, (f"{name}:",)) for r, name in (("u", "user"), ("a", "assistant")) if not audit.endswith("II")]
        if at < len(rows):
            _, role, text, fault = rows[at]
            grown.append(("D", 3, at + 1, "", ()))
            if fault not in ("blank", "duplicate"):
                cut = int(fault == "truncated")
                grown.append(("K", cut, at + 1, role[:1] or "?", (f"{role}:{text}",)))
                grown += [("R", 2 + cut, at + 1, r, (f"{name}:{text}",)) for r, name in (("u", "user"), ("a", "assistant"))]
        for letter, price, place, r, said in grown:
            if re.fullmatch(r"s?(ua)*u?", roles + r):
                heapq.heappush(heap, (cost + price, audit + letter, place, roles + r, out + said))
    turns = [t for t, *_ in rows if t is not None]
    faults = [f for *_, f in rows]
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    counts = tuple(faults.count(f) for f in ("blank", "duplicate", "truncated"))
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def random_conversations(seed, number, length):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(number)]:
        for turn in range(rng.randrange(length)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", None, "", "tool", "ufo"])
            text = rng.choice(["Fine.", "Cut", "So?\n", "", " \t", None, f"one {turn}.", f"two {turn}", "ünï 日本! ", "x " * 50])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 1, None, -3]), role, text))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


def repaired(spark, rows, **options):
    turns = spark.createDataFrame([(*r, 1, "x", b"k") for r in rows], SCHEMA + ", chunk int, audit string, kinds binary").repartition(3)
    return {r["conv_id"]: r for r in repair.repair(repair.structure_rows(turns), turns, **options).collect()}


@pytest.mark.parametrize(("seed", "length", "chunk_rows"), [(1, 7, 1), (2, 7, 3), (3, 8, 256)])
def test_repair_matches_search(spark, seed, length, chunk_rows):
    rows = random_conversations(seed, 40, length)
    got = repaired(spark, rows, chunk_rows=chunk_rows)
    ids = {r[0] for r in rows}
    assert set(got) == ids
    for conv in ids:
        assert tuple(got[conv])[1:-1] == plain_repair([r for r in rows if r[0] == conv]), conv
    assert max(r["chunks"] for r in got.values()) > (1 if chunk_rows < 4 else 0)


@pytest.mark.parametrize("role", [None, "user", "system"])
def test_chunks_that_never_converge_are_rerun(spark, role):
    """Rows that leave several cost vectors open over many chunks give the same as one chunk."""
    rows = [(1, t, role, f"said {t}.") for t in range(90)] + [(1, 90 + t, "user", " ") for t in range(30)] + [(1, 200, "assistant", "end.")]
    whole = repaired(spark, rows)[1]
    for chunk_rows in (2, 7):
        got = repaired(spark, rows, chunk_rows=chunk_rows)[1]
        assert tuple(got)[:-1] == tuple(whole)[:-1] and got["chunks"] >= 121 // chunk_rows


def test_long_conversation_keeps_its_rows(spark):
    rows = [(5, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(3000)]
    got = repaired(spark, rows)[5]
    assert got["audit"] == "K" * 3000 and got["cost"] == 0 and got["gaps"] == got["illegal"] == 0 and got["chunks"] >= 12
    text = "\n".join(f"{r}:{x}" for _, _, r, x in rows)
    assert got["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_empty_conversations(spark):
    nothing = hashlib.sha256(b"").hexdigest()
    asked = spark.createDataFrame([(7,), (7,), (None,)], "conv_id bigint")
    rows = spark.createDataFrame([], SCHEMA)
    got = sorted((tuple(r) for r in repair.repair(repair.structure_rows(rows), asked).collect()), key=str)
    assert got == [(7, 0, 0, 0, 0, 0, 0, "", nothing, 0), (None, 0, 0, 0, 0, 0, 0, "", nothing, 0)]
    assert repair.repair(repair.structure_rows(rows)).collect() == []


def test_damage_is_chosen_by_place(spark):
    import zlib

    rows = [(c, t, r, x) for c in (None, 1, 2) for t in (None, *range(60)) for r, x in [("system", "A. b! c?"), (None, None)]]
    got = sorted((tuple(r) for r in repair.damage(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    want = []
    for c, t, r, x in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if r is None else r, " " if x is None else x
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            want.append((c, t, "user" if fault == 4 else role, text, 2 if fault == 3 else 1))
    assert got == sorted(want, key=str)
