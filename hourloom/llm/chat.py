"""Chat formatting of typed content parts, with reversible escapes and a loss mask.

A visitor flattens the parts of a turn in order: texts are escaped, and images, audio and documents become numbered
placeholders, with a record of the attachment and of the tokens that it will take. A turn is a segment of the formatted
conversation; segments stream through a sorted partition, so a conversation of any length is never gathered.

Control strings inside texts get a backslash in front, and so do backslashes; `read_back` undoes that. The loss mask
covers exactly the escaped assistant texts.

Defined cases: null texts and roles count as empty; turns are ordered by turn (null first), then role, then text, so ties
and repeated rows have a fixed order and each makes a turn; rows with a null conv_id form one conversation; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The control strings of the template.
BEGIN, END = "<s>", "</s>"
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": (" ", END)}
OTHER_OPEN, OTHER_CLOSE = "[ROLE ", " [/ROLE]"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE ", "[/ROLE]", "<|image ", "<|audio ", "<|document ")

_ESCAPED = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_TOKEN = re.compile(r"\\.|<s>|</s>|\[INST\] | \[/INST\]|\[SYS\] | \[/SYS\]|\[ROLE | \[/ROLE\]", re.DOTALL)
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<placeholder:string,kind:string,ref:string,tokens:int>"
SEGMENT = (
    "conv_id bigint, position bigint, role string, formatted string, loss_start int, loss_end int, "
    f"attachments array<{ATTACHMENT}>, expanded_tokens bigint"
)


@dataclass(frozen=True)
class PartCosts:
    """Tokens that an attachment takes: per image tile, per second of audio, per document page."""

    tile: int = 512
    per_tile: int = 256
    per_second: int = 25
    per_page: int = 800


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


@dataclass
class Flattener:
    """Visitor over the typed parts of a conversation; placeholders are numbered through all its turns."""

    costs: PartCosts = field(default_factory=PartCosts)
    counts: dict[str, int] = field(default_factory=dict)

    def flatten(self, parts: list[dict]) -> tuple[str, list[tuple]]:
        out, attachments = [], []
        for part in parts:
            visit = getattr(self, f"visit_{part.get('kind') or 'text'}", None)
            if visit is None:
                raise ValueError(f"unknown kind of part: {part.get('kind')}")
            text, attachment = visit(part)
            out.append(text)
            if attachment:
                attachments.append(attachment)
        return "".join(out), attachments

    def visit_text(self, part):
        return escape(part.get("text") or ""), None

    def visit_image(self, part):
        tiles = max(1, -(-(part.get("width") or 1) // self.costs.tile)) * max(1, -(-(part.get("height") or 1) // self.costs.tile))
        return self._placed("image", part, tiles * self.costs.per_tile)

    def visit_audio(self, part):
        return self._placed("audio", part, max(1, round((part.get("seconds") or 0) * self.costs.per_second)))

    def visit_document(self, part):
        return self._placed("document", part, max(1, part.get("pages") or 1) * self.costs.per_page)

    def _placed(self, kind, part, tokens):
        self.counts[kind] = self.counts.get(kind, 0) + 1
        placeholder = f"<|{kind} {self.counts[kind]}|>"
        return placeholder, (placeholder, kind, part.get("ref"), tokens)


def segment(role: str, body: str, first: bool) -> tuple[str, int | None, int | None]:
    """Formatted turn, and where its loss mask starts and ends (code points within the segment)."""
    if role in MARKS:
        before, after = MARKS[role]
    else:
        before, after = OTHER_OPEN + escape(role).replace("]", "\\]") + "] ", OTHER_CLOSE
    before = BEGIN + before if first else before
    loss = (len(before), len(before) + len(body)) if role == "assistant" else (None, None)
    return before + body + after, *loss


def _format(batches: Iterable[pa.RecordBatch], costs: PartCosts) -> Iterator[pa.RecordBatch]:
    key, position, flattener = object(), 0, Flattener(costs)
    schema = None
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            if row["conv_id"] != key:
                key, position, flattener = row["conv_id"], 0, Flattener(costs)
            role = row["role"] or ""
            body, attachments = flattener.flatten(row["parts"] or [{"kind": "text", "text": row["text"]}])
            formatted, start, end = segment(role, body, position == 0)
            held = [dict(zip(("placeholder", "kind", "ref", "tokens"), a)) for a in attachments]
            rows.append(
                {
                    "conv_id": key,
                    "position": position,
                    "role": role,
                    "formatted": formatted,
                    "loss_start": start,
                    "loss_end": end,
                    "attachments": held,
                    "expanded_tokens": sum(a[3] for a in attachments),
                }
            )
            position += 1
        schema = schema or _arrow_schema()
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _arrow_schema() -> pa.Schema:
    attachment = pa.struct([("placeholder", pa.string()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())])
    return pa.schema(
        [
            ("conv_id", pa.int64()),
            ("position", pa.int64()),
            ("role", pa.string()),
            ("formatted", pa.string()),
            ("loss_start", pa.int32()),
            ("loss_end", pa.int32()),
            ("attachments", pa.list_(attachment)),
            ("expanded_tokens", pa.int64()),
        ]
    )


def format_turns(
    turns: DataFrame, costs: PartCosts = PartCosts(), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: str | None = None
) -> DataFrame:
    """One segment per turn; the conversation is the concatenation of its segments by position.

    `parts` names a column of typed parts that, where it is not null, replaces the text.
    """
    source = turns.select(
        F.col(conv_id).cast("bigint").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.col(role).alias("role"),
        F.col(text).alias("text"),
        (F.col(parts) if parts else F.lit(None)).cast(f"array<{PART}>").alias("parts"),
    )
    ordered = source.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(lambda batches: _format(batches, costs), SEGMENT)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, escaped body) of every turn in a formatted text."""
    turns, role, low, named, at = [], None, 0, None, 0
    closing = {" [/INST]": "user", " [/SYS]": "system", END: "assistant", " [/ROLE]": None}
    while m := _TOKEN.search(formatted, at):
        token, at = m.group(), m.end()
        if token[0] == "\\":
            continue
        if token == BEGIN:
            low = at
        elif token == "[INST] ":
            role, low = "user", at
        elif token == "[SYS] ":
            role, low = "system", at
        elif token == OTHER_OPEN:
            named = re.compile(r"(?:\\.|[^\\\]])*", re.DOTALL).match(formatted, at)
            role, low = unescape(named.group()), named.end() + 2
            at = low
        elif token in closing:
            if token == END:
                turns.append(("assistant", formatted[low + len(MARKS["assistant"][0]) : m.start()]))
            else:
                turns.append((role, formatted[low : m.start()]))
            role, low = None, at
    return turns


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    state = None

    def row(s):
        return [s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]]

    for batch in batches:
        done = []
        columns = (batch.column(n).to_pylist() for n in ("conv_id", "formatted", "loss_start", "loss_end"))
        for conv, formatted, start, end in zip(*columns):
            if state is None or state[0] != conv:
                if state is not None:
                    done.append(row(state))
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, body in parse(formatted):
                state[1] += 1
                state[2].update(f"{role}\n{unescape(body)}\n".encode())
            if start is not None:
                learned = unescape(formatted[start:end])
                state[3] += len(learned)
                state[4].update(learned.encode())
            state[5] += len(formatted)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done) if done else [[]] * 6, kinds)], names=names)
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row(state), kinds)], names=names)


def read_back(segments: DataFrame) -> DataFrame:
    """Digests per conversation, read from the formatted text and its loss mask alone, one segment at a time."""
    ordered = segments.select("conv_id", "position", "formatted", "loss_start", "loss_end")
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return ordered.mapInArrow(_digests, schema)
