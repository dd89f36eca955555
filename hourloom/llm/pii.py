"""Personal data in whole texts: rules for four kinds, and a character tagger that adds what the rules leave out.

The rules find e-mail addresses, IPv4 addresses, card numbers and phone numbers, leftmost and non-overlapping per kind;
a match that fails its check is dropped. Their spans label the windows on which the tagger (BiLSTM with CRF) is trained,
on a bounded sample of documents. The tagger then reads every stretch of whole words around a digit or an `@`, without one
of which no span of these kinds exists, and adds the spans that overlap none of the rules' and of which it is sure.

Defined cases: null and empty texts have no spans; without a document to train on the tagger adds nothing; long texts are
read whole, in overlapping windows; repeated rows are answered each; other columns are not read. Positions are code points,
ends exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm.arrow import bounded, map_texts
from hourloom.llm.tagger import Tagger, TaggerConfig, char_codes
from hourloom.llm.training import first_by_hash, fit_in_one_task

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[0-9]")
_BLANK = re.compile(r"\s")
SPAN = "array<struct<kind:string,start:int,end:int>>"


@dataclass(frozen=True)
class PiiConfig:
    """`documents` of at most `max_bytes` each train the tagger; `margin` code points around a trigger's word are read, and the words they touch."""

    documents: int = 600
    max_bytes: int = 32_768
    margin: int = 24
    sure: float = 0.95
    shortest: int = 6
    tagger: TaggerConfig = field(default_factory=TaggerConfig)


# --- rules ----------------------------------------------------------------------------------------------------------


def email_spans(text: str) -> list[tuple[int, int]]:
    """An address is found from its `@`: the run of local characters before it and the domain after it."""
    spans, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            spans.append((start, done))
        at = text.find("@", max(at + 1, done))
    return spans


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[0::2]) + sum(d * 2 - 9 * (d > 4) for d in values[1::2])) % 10 == 0


def _digits_of(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    spans = [(0, a, b) for a, b in email_spans(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            spans.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _digits_of(m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits_of(m.group())) <= 15:
            spans.append((3, *m.span()))
    return spans


def stretches_of(text: str, margin: int) -> list[tuple[int, int]]:
    """Stretches of whole words: those that hold a digit or `@` and those within `margin` code points of them."""
    out: list[tuple[int, int]] = []
    done = 0

    def end_of_word(at: int) -> int:
        space = _BLANK.search(text, at)
        return space.start() if space else len(text)

    for m in _TRIGGER.finditer(text):
        if m.end() <= done:
            continue
        low = m.start()
        while low > done and not text[low - 1].isspace():
            low -= 1
        low, done = max(0, low - margin), end_of_word(m.end())
        held = out[-1][1] if out else 0
        while low > held and not text[low - 1].isspace():
            low -= 1
        high = end_of_word(min(len(text), done + margin))
        if out and low <= held:
            out[-1] = (out[-1][0], max(held, high))
        else:
            out.append((low, high))
    return out


# --- tagger ---------------------------------------------------------------------------------------------------------


def training_windows(texts: list[str], config: PiiConfig) -> tuple[np.ndarray, np.ndarray]:
    """Windows of codes and of BIO tags over the stretches of the texts, labelled by the rules."""
    size, stride = config.tagger.window, config.tagger.stride
    codes, tags = [], []
    for text in texts:
        whole, marks = char_codes(text), np.zeros(len(text), dtype=np.int64)
        for kind, a, b in reversed(rule_spans(text)):
            marks[a:b] = 2 + 2 * kind
            marks[a] = 1 + 2 * kind
        inside = marks > 0
        broken = inside & (marks % 2 == 0) & np.concatenate([[True], (marks[:-1] != marks[1:]) & (marks[:-1] != marks[1:] - 1)])
        marks[broken] -= 1
        for low, high in stretches_of(text, config.margin):
            for a in range(low, max(low + 1, high - size + stride), stride):
                b = min(a + size, high)
                row, mark = np.zeros(size, np.int64), np.zeros(size, np.int64)
                row[: b - a], mark[: b - a] = whole[a:b], marks[a:b]
                if mark[0] and mark[0] % 2 == 0:
                    mark[0] -= 1
                codes.append(row)
                tags.append(mark)
    if not codes:
        return np.zeros((0, size), np.int64), np.zeros((0, size), np.int64)
    return np.stack(codes), np.stack(tags)


def fit_tagger(texts: list[str], config: PiiConfig = PiiConfig()) -> Tagger | None:
    codes, tags = training_windows(texts, config)
    if not len(codes):
        return None
    tagger = Tagger(len(KINDS), config.tagger)
    tagger.fit(codes, tags)
    return tagger


def train(docs: DataFrame, config: PiiConfig = PiiConfig(), doc_id: str = "doc_id", text: str = "text") -> Tagger | None:
    """Tagger from a sample in hash order of the documents that hold a digit or an `@`."""
    source = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("t"))
    source = source.where((F.octet_length("t") <= config.max_bytes) & F.col("t").rlike("[0-9@]"))
    rows = first_by_hash(source, config.documents).withColumn("order", F.xxhash64("id", "t"))

    def fit_rows(held: list[dict]) -> Tagger | None:
        held.sort(key=lambda r: (r["order"], r["id"] or "", r["t"]))
        return fit_tagger([r["t"] for r in held], config)

    return fit_in_one_task(rows, fit_rows)


def added_spans(texts: list[str], rules: list[list[tuple]], tagger: Tagger | None, config: PiiConfig) -> list[list[tuple[int, int, int]]]:
    """What the tagger finds beside the rules' spans, per text."""
    out: list[list] = [[] for _ in texts]
    if tagger is None:
        return out
    where = [(i, a, b) for i, t in enumerate(texts) for a, b in stretches_of(t, config.margin)]
    codes = [char_codes(t) for t in texts]
    for (i, a, _), spans in zip(where, tagger.decode([codes[i][a:b] for i, a, b in where])):
        for kind, start, end, sure in spans:
            start, end = start + a, end + a
            apart = all(end <= low or high <= start for _, low, high in rules[i])
            if apart and sure >= config.sure and end - start >= config.shortest and _TRIGGER.search(texts[i], start, end):
                out[i].append((kind, start, end))
    return out


def _with_triggers(column: pa.Array) -> np.ndarray:
    """Places of the texts that hold a digit or an `@`."""
    whole = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, values = whole.buffers()
    if values is None:
        return np.zeros(0, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(values, dtype=np.uint8)[at[0] : at[-1]]
    hits = np.flatnonzero(((data >= 48) & (data <= 57)) | (data == 64)) + at[0]
    return np.unique(np.searchsorted(at, hits, "right") - 1)


def find_in(column: pa.Array, tagger: Tagger | None, config: PiiConfig) -> tuple[list[list], list[list]]:
    """The rules' spans and the added spans of every text of a column."""
    base: list[list] = [[] for _ in range(len(column))]
    more: list[list] = [[] for _ in range(len(column))]
    places = _with_triggers(column)
    texts = column.take(pa.array(places)).to_pylist()
    rules = [rule_spans(t) for t in texts]
    for i, own, added in zip(places.tolist(), rules, added_spans(texts, rules, tagger, config)):
        base[i], more[i] = own, added
    return base, more


def _span_array(rows: list[list[tuple]]) -> pa.Array:
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    return pa.array([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in r] for r in rows], pa.list_(kind))


def find_personal_data(docs: DataFrame, tagger: Tagger | None, config: PiiConfig = PiiConfig(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, spans): the rules' spans, and all spans, each by kind, then start."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def make():
        own = shared.value

        def apply(piece):
            base, more = find_in(piece.column(1), own, config)
            spans = [sorted(b + m) for b, m in zip(base, more)]
            return pa.RecordBatch.from_arrays([piece.column(0), _span_array(base), _span_array(spans)], names=["doc_id", "base", "spans"])

        return apply

    return map_texts(docs, [doc_id], text, f"doc_id bigint, base {SPAN}, spans {SPAN}", make)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span, overlapping ones together, replaced by the kind of the first."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], s[2], s[0])):
        if start >= done:
            out += [text[done:start], f"<{KINDS[kind].upper()}>"]
        done = max(done, end)
    return "".join(out) + text[done:]


def redact_rows(docs: DataFrame, tagger: Tagger | None, config: PiiConfig = PiiConfig(), text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The same rows with personal data replaced; `n_chars`, if there, follows the text, other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    names = docs.columns
    place = names.index(text)

    def run(batches):
        own = shared.value
        for piece in bounded(batches, place):
            column = piece.column(place)
            base, more = find_in(column, own, config)
            hit = [i for i in range(len(base)) if base[i] or more[i]]
            if hit:
                texts = column.to_pylist()
                for i in hit:
                    texts[i] = redact(texts[i], base[i] + more[i])
                columns = [pa.array(texts, column.type) if k == place else piece.column(k) for k in range(piece.num_columns)]
                piece = pa.RecordBatch.from_arrays(columns, names=names)
            yield piece

    out = docs.mapInArrow(run, docs.schema)
    if n_chars in names:
        kind = dict(docs.dtypes)[n_chars]
        length = F.when(out[text].isNull(), out[n_chars]).otherwise(F.length(out[text]).cast(kind))
        out = out.withColumn(n_chars, length)
    return out
