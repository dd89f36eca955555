import random
import re

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import ODD_TEXTS, documents

from hourloom.llm import pii
from hourloom.llm.tagger import Tagger, TaggerConfig, char_codes

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    def digits(s):
        return re.sub("[^0-9]", "", s)

    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15]


def test_rules_match_plain_patterns():
    rng = random.Random(5)
    for _ in range(30_000):
        text = "".join(rng.choice("ab1.@- 1+(25%é") for _ in range(rng.randint(0, 40)))
        assert pii.rule_spans(text) == plain_spans(text)
    assert pii.rule_spans("4111 1111 1111 1111") == [(2, 0, 19)]


def test_long_runs_stay_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1.2.3." * 30_000 + "x", "+1" + "(" * 100_000, "@" * 100_000):
        assert {s[0] for s in pii.rule_spans(text)} <= {1}


def test_gradients():
    tagger = Tagger(2, TaggerConfig(window=7, embed=3, hidden=4))
    rng = np.random.default_rng(0)
    codes, tags = rng.integers(1, 20, (3, 7)), np.array([[0, 1, 2, 2, 0, 3, 4], [0] * 7, [1, 1, 2, 0, 0, 0, 3]])
    _, g = tagger.gradients(codes, tags)
    for name, values in tagger.p.items():
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in values.shape)
            if name == "move" and tagger.barred[at]:
                continue
            losses = []
            for step in (1e-5, -2e-5):
                values[at] += step
                losses.append(tagger.gradients(codes, tags)[0])
            values[at] += 1e-5
            assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(g[name][at], abs=1e-5)


def sample_texts(n, seed):
    rng = random.Random(seed)

    def word():
        return "".join(rng.choice("abcdehnorst") for _ in range(rng.randint(2, 8)))

    def number(k):
        return "".join(rng.choice("0123456789") for _ in range(k))

    def card():
        body = number(15)
        return next(body + d for d in "0123456789" if pii.luhn(body + d))

    makers = [
        lambda: f"{word()}.{number(2)}@{word()}.example.com",
        lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        card,
        lambda: f"+1 ({number(3)}) 555-{number(4)}",
        lambda: number(rng.randint(1, 6)),
    ]
    return [" ".join(rng.choice(makers)() if rng.random() < 0.1 else word() for _ in range(40)) for _ in range(n)]


@pytest.fixture(scope="module")
def tagger():
    return pii.fit_tagger(sample_texts(300, 1))


def test_tagger_agrees_on_held_out_texts(tagger):
    texts = sample_texts(100, 2)
    found = pii.added_spans(texts, [[] for _ in texts], tagger, pii.PiiConfig(sure=0.0))
    want = [set(pii.rule_spans(t)) for t in texts]
    hits = sum(len(w & set(f)) for w, f in zip(want, found))
    assert hits >= 0.9 * sum(map(len, want)) and hits >= 0.85 * sum(map(len, found))


def test_long_stretch_is_one_tagging(tagger):
    email = "some.one12@mail.example.com"
    text = f"{'1 ' * 300}{email}{' 2' * 300}"
    assert (0, 600, 600 + len(email)) in [s[:3] for s in tagger.decode([char_codes(text)])[0]]


def test_odd_rows(spark, tagger):
    texts = [*ODD_TEXTS, "é a@b.cc 😀 1.2.3.4", "a@b.cc, a@b.cc", "a@b.cc, a@b.cc", "z" * 50_000 + " a@b.cc"]
    ids = [*range(9), None, 20, 20, 21]
    docs = documents(spark, texts, ids=ids, clash=True)
    for model in (tagger, None):
        rows = pii.find_personal_data(docs, model).collect()
        got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, str([(s["kind"], s["start"], s["end"]) for s in r["base"]])) for r in rows)
        want = sorted((i if i is not None else -1, str([(pii.KINDS[k], a, b) for k, a, b in plain_spans(t or "")])) for i, t in zip(ids, texts))
        assert got == want
        assert all({tuple(s) for s in r["base"]} <= {tuple(s) for s in r["spans"]} for r in rows)
    assert pii.find_personal_data(docs.limit(0), tagger).collect() == []
    assert pii.train(docs.limit(0)) is None


def test_redaction(spark):
    docs = documents(spark, [None, "x a@b.cc y 1.2.3.4", "plain"], clash=True)
    got = {r["doc_id"]: r for r in pii.redact_rows(docs, None).collect()}
    assert got[1]["text"] == "x <EMAIL> y <IP>" and got[1]["n_chars"] == 16
    assert got[0]["text"] is None and got[0]["n_chars"] is None and got[2]["text"] == "plain"
    assert pii.redact_rows(docs, None).columns == docs.columns
    assert pii.redact("+1 2345678 90", [(3, 0, 10), (2, 3, 13)]) == "<PHONE>"


def test_triggers_are_found_in_slices():
    column = pa.array(["none", "a1", None, "x@", ""]).slice(1)
    assert pii._with_triggers(column).tolist() == [0, 2]


def test_long_runs_of_zeros_are_read():
    text = "x " + "0" * 5000 + ".1.2.3 y"
    assert (1, 2, 5008) in pii.rule_spans(text)
    assert not [s for s in pii.rule_spans("0" * 5000 + "256.1.2.3") if s[0] == 1]


def test_stretches_hold_whole_words(tagger):
    for text in ("x " * 40 + "a" * 60 + "@intranet y", "a" * 60 + " 1", "1 " + "b" * 60, "1" * 60 + "c" * 60 + " d", "a1 " + "b" * 90 + " 2c"):
        held = pii.stretches_of(text, 24)
        assert all(a == 0 or text[a - 1].isspace() for a, _ in held) and all(b == len(text) or text[b].isspace() for _, b in held)
        assert all(any(a <= i < b for a, b in held) for i, c in enumerate(text) if c in "0123456789@")
        assert all(x[1] < y[0] for x, y in zip(held, held[1:]))
    assert pii.stretches_of("x " * 40 + "a" * 60 + "@intranet y", 24)[0][0] <= 80
    assert pii.stretches_of("1" * 200_000, 24) == [(0, 200_000)]


def test_an_added_address_keeps_its_head():
    text = "write to " + "long.local.part.of.a.name.without.end@intranet" + " now"

    class Words:
        """Tags the word that holds an `@`."""

        def decode(self, rows):
            out = []
            for row in rows:
                own = "".join(chr(c + 31) for c in row.tolist())
                at = own.index("@")
                low, high = own.rfind(" ", 0, at) + 1, own.find(" ", at)
                out.append([(0, low, high if high >= 0 else len(own), 1.0)])
            return out

    found = pii.added_spans([text], [[]], Words(), pii.PiiConfig())
    assert [text[a:b] for _, a, b in found[0]] == ["long.local.part.of.a.name.without.end@intranet"]
