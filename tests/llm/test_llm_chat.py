import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hourloom.llm import chat

TRICKY = st.text(alphabet="ab\\[]</>s|INTROLEY 1\n", max_size=30) | st.sampled_from(["</s>[INST] ok [/INST]", " [/SYS]", "\\", "<|image 1|>", ""])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "a]b\\", ""]), TRICKY), max_size=6))
def test_formatted_text_reads_back(turns):
    pieces = [chat.segment(role, chat.escape(text), n == 0) for n, (role, text) in enumerate(turns)]
    whole = "".join(p[0] for p in pieces)
    assert [(role, chat.unescape(body)) for role, body in chat.parse(whole)] == turns
    learned = [chat.unescape(p[0][p[1] : p[2]]) for p in pieces if p[1] is not None]
    assert learned == [text for role, text in turns if role == "assistant"]


def test_parts_become_placeholders(spark):
    rows = [
        (1, 0, "user", "ignored", [("text", "look ", None, None, None, None, None), ("image", None, "u1", 600, 512, None, None), ("audio", None, "u2", None, None, 2.0, None)]),
        (1, 1, "assistant", "fine", None),
        (1, 2, "user", None, [("image", None, "u3", None, None, None, None), ("document", None, "u4", None, None, None, 3), ("text", "<s>", None, None, None, None, None)]),
    ]
    turns = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, text string, parts array<{chat.PART}>")
    got = chat.format_turns(turns, parts="parts").orderBy("position").collect()
    assert got[0]["formatted"] == "<s>[INST] look <|image 1|><|audio 1|> [/INST]"
    assert got[2]["formatted"] == "[INST] <|image 2|><|document 1|>\\<s> [/INST]"
    assert [[(a["placeholder"], a["ref"], a["tokens"]) for a in r["attachments"]] for r in got] == [
        [("<|image 1|>", "u1", 512), ("<|audio 1|>", "u2", 50)],
        [],
        [("<|image 2|>", "u3", 256), ("<|document 1|>", "u4", 2400)],
    ]
    assert [r["expanded_tokens"] for r in got] == [562, 0, 2656]


def test_unknown_parts_are_refused():
    with pytest.raises(ValueError):
        chat.Flattener().flatten([{"kind": "video"}])


def test_odd_rows(spark):
    import hashlib

    rows = [(None, 1, "user", "n"), (7, None, "assistant", "first"), (7, 2, None, None), (7, 2, "assistant", "z"), (7, 2, "assistant", "z"), (7, 3, "assistant", "long " * 50_000)]
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string, position int")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    order = [("assistant", "first"), ("", ""), ("assistant", "z"), ("assistant", "z"), ("assistant", "long " * 50_000)]
    assert got[7]["n_turns"] == 5 and got[None]["n_turns"] == 1
    assert got[7]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in order).encode()).hexdigest()
    learned = "".join(t for r, t in order if r == "assistant")
    assert got[7]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest() and got[7]["loss_chars"] == len(learned)
    assert got[None]["loss_chars"] == 0
    assert chat.read_back(chat.format_turns(turns.limit(0))).collect() == []
