"""Repair of conversation structure: the cheapest edits that make the turns alternate, by rank-convergence parallel Viterbi.

A conversation is legal if its role initials read `(s?(ua)+)?`. Keep costs 0, Rerole (to user or assistant) 2, Delete 3 and
must be taken for blank and duplicate rows, Insert (an empty user or assistant turn, anywhere) 2; a truncated row that is
not deleted adds 1. Among the cheapest edits those with the ASCII-least initials win.

The costs are found backwards, in four states (nothing yet, after s, after u, after a). A cost vector matters only up to a
constant, and only a few vectors can occur at all (`SHAPES`). So conversations of any length are cut into chunks of rows:

1. every chunk starts from all these vectors as guesses for its right edge and steps to its left edge; guesses that come to
   differ only by constants are one from there on, and mostly a single one is left (the rank has converged);
2. chunks with several left are rerun from what their right neighbours have left, neighbours 1, 2, 4, ... chunks away, until
   each has a single vector: the true one, whatever was guessed;
3. the stitched backward costs let every chunk trace its least audit for each of the four states it may be entered in;
4. one pass over a conversation's chunks picks the state it is in, and hashes the repaired rows as a stream.

A conversation's light rows (digests, no texts) are dealt over tasks by range, so one that holds a third of all rows is cut
like any other; equal rows are counted before any of it. Step 4 is a stream per conversation, since a hash over its whole
text is asked for; it holds one row and the audit.

Defined cases: a null role or text is one space (so such a text is blank); null conv_ids are one conversation; null turns
come first; rows of one turn are in order of role, the first 64 characters of the text, and the text's SHA-256; equal rows
count each; a conversation without rows has zeros, an empty audit and the hash of nothing; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.session import materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
CHUNK_ROWS = 256
SPACES = r"[\x20\x09-\x0D]"

# States: 0 nothing yet, 1 after a system turn, 2 after a user turn, 3 after an assistant turn.
STATES = range(4)
LEGAL_END = (0, 3)
_NEXT = (2, 2, 3, 2)
_KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ROLE = {2: "user", 3: "assistant"}

# Row kinds: initial (s, u, a, any other) with or without a cut end, and rows that must go.
KINDS = [(initial, cut) for initial in ("s", "u", "a", "") for cut in (0, 1)]
GONE = len(KINDS)


def _inserted(costs: list[int]) -> list[int]:
    for _ in STATES:
        costs = [min(costs[q], INSERT + costs[_NEXT[q]]) for q in STATES]
    return costs


def _before(kind: int, after: tuple[int, ...]) -> list[int]:
    """Costs in front of a row, inserts allowed, from the costs behind it."""
    if kind == GONE:
        return _inserted([DELETE + after[q] for q in STATES])
    initial, cut = KINDS[kind]
    costs = []
    for q in STATES:
        options = [DELETE + after[q], REROLE + cut + after[_NEXT[q]]]
        if q in _KEPT.get(initial, {}):
            options.append(KEEP + cut + after[_KEPT[initial][q]])
        costs.append(min(options))
    return _inserted(costs)


def _shape(costs: list[int]) -> tuple[int, ...]:
    low = min(costs)
    return tuple(c - low for c in costs)


def _all_shapes() -> tuple[list[tuple[int, ...]], list[list[int]]]:
    """Every vector that rows can lead to from the end of a conversation, and the step of each row kind between them."""
    far = 1 << 20
    found = [_shape(_inserted([0 if q in LEGAL_END else far for q in STATES]))]
    steps: list[list[int]] = [[] for _ in range(GONE + 1)]
    for after in found:
        for kind in range(GONE + 1):
            before = _shape(_before(kind, after))
            if before not in found:
                found.append(before)
            steps[kind].append(found.index(before))
    return found, steps


SHAPES, _STEPS = _all_shapes()
END = 0  # the shape behind a conversation's last row


def _least_edits(kind: int, after: int, state: int) -> tuple[str, int, int]:
    """(initials, cost, next state) of the ASCII-least cheapest way over one row."""
    behind, initials, spent = SHAPES[after], "", 0
    costs = _before(kind, behind)
    cut = 0 if kind == GONE else KINDS[kind][1]
    while True:
        if costs[state] == DELETE + behind[state]:
            return initials + "D", spent + DELETE, state
        if costs[state] == INSERT + costs[_NEXT[state]]:
            initials, spent, state = initials + "I", spent + INSERT, _NEXT[state]
            continue
        kept = _KEPT.get(KINDS[kind][0], {}).get(state)
        if kept is not None and costs[state] == KEEP + cut + behind[kept]:
            return initials + "K", spent + KEEP + cut, kept
        return initials + "R", spent + REROLE + cut, _NEXT[state]


_EDITS = [[[_least_edits(kind, after, q) for q in STATES] for after in range(len(SHAPES))] for kind in range(GONE + 1)]


def closing(state: int) -> tuple[str, int]:
    """Inserts after the last row."""
    count = {0: 0, 1: 2, 2: 1, 3: 0}[state]
    return "I" * count, INSERT * count


def left_shapes(kinds: bytes) -> list[int]:
    """For every shape guessed at a chunk's right edge, the shape at its left edge; equal guesses are stepped once."""
    guesses = {s: [s] for s in range(len(SHAPES))}
    for kind in reversed(kinds):
        if kind == GONE:
            continue
        step, merged = _STEPS[kind], {}
        for shape, origins in guesses.items():
            merged.setdefault(step[shape], []).extend(origins) if step[shape] in merged else merged.update({step[shape]: origins})
        guesses = merged
    image = [0] * len(SHAPES)
    for shape, origins in guesses.items():
        for origin in origins:
            image[origin] = shape
    return image


def trace(kinds: bytes, copies: list[int], right: int) -> tuple[list[str], list[int], list[int]]:
    """Per entering state: least audit of a chunk, its cost, and the state it is left in."""
    behind = [right] * len(kinds)
    for i in range(len(kinds) - 1, 0, -1):
        right = right if kinds[i] == GONE else _STEPS[kinds[i]][right]
        behind[i - 1] = right
    audits, costs, ends = [], [], []
    for state in STATES:
        initials, cost = [], 0
        for kind, again, after in zip(kinds, copies, behind):
            letters, spent, state = _EDITS[kind][after][state]
            initials.append(letters + "D" * (again - 1))
            cost += spent + DELETE * (again - 1)
        audits.append("".join(initials))
        costs.append(cost)
        ends.append(state)
    return audits, costs, ends


def blank(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACES, "")) == 0


def truncated(text: Column) -> Column:
    return ~F.rlike(text, F.lit(r"[.!?]" + SPACES + r"*\z"))


def structure_rows(turns: DataFrame, conv_id="conv_id", turn="turn", role="role", text="text", copies: str | None = None) -> DataFrame:
    """The rows that the operator works on; `copies` names a column that says how often a row stands there."""
    words = F.coalesce(F.col(text), F.lit(" "))
    return turns.select(
        F.col(conv_id).cast("bigint").alias("conv_id"),
        F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        words.alias("text"),
        F.substring(words, 1, 64).alias("head"),
        F.sha2(words, 256).alias("digest"),
        (F.col(copies) if copies else F.lit(1)).cast("bigint").alias("copies"),
    )


_ORDER = ["conv_id", "turn", "role", "head", "digest"]
_CHUNK = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("part", pa.int32()),
        ("block", pa.int64()),
        ("kinds", pa.binary()),
        ("copies", pa.list_(pa.int64())),
        ("image", pa.list_(pa.int32())),
        ("first_turn", pa.int64()),
        ("last_turn", pa.int64()),
        ("turns", pa.int64()),
        ("first_initial", pa.string()),
        ("last_initial", pa.string()),
        ("illegal", pa.int64()),
        ("blank", pa.int64()),
        ("duplicate", pa.int64()),
        ("truncated", pa.int64()),
    ]
)
CHUNK_SCHEMA = (
    "conv_id bigint, part int, block bigint, kinds binary, copies array<bigint>, image array<int>, first_turn bigint, last_turn bigint, turns bigint, "
    "first_initial string, last_initial string, illegal bigint, blank bigint, duplicate bigint, truncated bigint"
)


def illegal_pair(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


class _Chunk:
    """Up to `CHUNK_ROWS` sorted rows of one conversation."""

    def __init__(self, conv_id, part, block):
        self.at = (conv_id, part, block)
        self.kinds, self.copies = bytearray(), []
        self.first_turn = self.last_turn = self.first_initial = self.last_initial = None
        self.turns = self.illegal = self.blank = self.duplicate = self.truncated = 0

    def add(self, turn, initial, is_blank, is_cut, is_again, copies):
        gone = is_blank or is_again
        cut = is_cut and not gone
        self.kinds.append(GONE if gone else KINDS.index((initial if initial in _KEPT else "", int(cut))))
        self.copies.append(copies)
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if self.first_initial is None:
            self.first_initial = initial
        else:
            self.illegal += illegal_pair(self.last_initial, initial)
        self.last_initial = initial
        self.illegal += copies - 1
        if is_blank:
            self.blank += copies
        else:
            self.duplicate += copies if is_again else copies - 1
            self.truncated += cut

    def row(self):
        kinds = bytes(self.kinds)
        return (
            *self.at, kinds, self.copies, left_shapes(kinds), self.first_turn, self.last_turn, self.turns,
            self.first_initial, self.last_initial, self.illegal, self.blank, self.duplicate, self.truncated,
        )


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _cut(batches: Iterable[pa.RecordBatch], chunk_rows: int) -> Iterator[pa.RecordBatch]:
    chunk = None
    for batch in batches:
        done = []
        for conv_id, turn, initial, is_blank, is_cut, is_again, copies, part in zip(*(c.to_pylist() for c in batch.columns)):
            if chunk is None or chunk.at[0] != conv_id or len(chunk.kinds) == chunk_rows:
                block = 0 if chunk is None or chunk.at[0] != conv_id else chunk.at[2] + 1
                if chunk is not None:
                    done.append(chunk.row())
                chunk = _Chunk(conv_id, part, block)
            chunk.add(turn, initial, is_blank, is_cut, is_again, copies)
        yield _batch(done, _CHUNK)
    if chunk is not None:
        yield _batch([chunk.row()], _CHUNK)


def _chunks(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """Chunks of every conversation in order, numbered from 0, `last` true for its last."""
    light = rows.groupBy(*_ORDER).agg(
        F.sum("copies").alias("copies"), F.first(blank(F.col("text"))).alias("is_blank"), F.first(truncated(F.col("text"))).alias("is_cut")
    )
    light = materialize(light.withColumn("spread", F.pmod(F.xxhash64("turn"), F.lit(64))), "light_rows")
    where = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    said = ["conv_id", "role", "digest"]
    partial = light.where("not is_blank").groupBy(*said, "spread").agg(F.min(where).alias("first"), F.count("*").alias("n"))
    again = materialize(partial.groupBy(*said).agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1").drop("n"), "said_again")
    other = again.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    same = light["conv_id"].eqNullSafe(other["c"]) & (light["role"] == other["r"]) & (light["digest"] == other["d"])
    marked = light.join(other, same, "left").withColumn("is_again", F.coalesce(where != F.col("first"), F.lit(False)) & ~F.col("is_blank"))
    ordered = marked.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    ordered = ordered.select(
        "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "is_blank", "is_cut", "is_again", "copies", F.spark_partition_id().alias("part")
    )
    cut = materialize(ordered.mapInArrow(lambda batches: _cut(batches, chunk_rows), CHUNK_SCHEMA), "chunks")
    # A conversation has one row here per task that its rows were dealt to.
    dealt = cut.groupBy("conv_id", "part").agg(F.count("*").alias("blocks")).groupBy("conv_id").agg(F.collect_list(F.struct("part", "blocks")).alias("parts"))
    earlier = F.aggregate(F.filter("parts", lambda p: p["part"] < F.col("part")), F.lit(0).cast("bigint"), lambda s, p: s + p["blocks"])
    total = F.aggregate("parts", F.lit(0).cast("bigint"), lambda s, p: s + p["blocks"])
    whole = dealt.withColumnRenamed("conv_id", "c")
    numbered = cut.join(whole, cut["conv_id"].eqNullSafe(whole["c"])).withColumn("chunk", earlier + F.col("block"))
    return materialize(numbered.withColumn("last", F.col("chunk") == total - 1).drop("c", "parts", "part", "block"), "numbered_chunks")


def _same_chunk(left: DataFrame, right: DataFrame, ahead: int) -> Column:
    return left["conv_id"].eqNullSafe(right["c"]) & (left["chunk"] + ahead == right["at"])


def _true_shapes(chunks: DataFrame) -> DataFrame:
    """(conv_id, chunk, shape): the shape at the left edge of every chunk of a conversation that has several."""
    several = chunks.where("chunk > 0 or not last")
    known = several.select("conv_id", "chunk", F.when(F.col("last"), F.transform("image", lambda _: F.col("image")[END])).otherwise(F.col("image")).alias("image"))
    ahead = 1
    while True:
        known = materialize(known.withColumn("open", F.size(F.array_distinct("image")) > 1), "fix_up")
        unsettled = known.where("open")
        if unsettled.isEmpty():
            return known.select("conv_id", "chunk", F.col("image")[0].alias("shape"))
        right = known.select(F.col("conv_id").alias("c"), F.col("chunk").alias("at"), F.col("image").alias("theirs"))
        rerun = unsettled.join(right, _same_chunk(unsettled, right, ahead))
        rerun = rerun.select("conv_id", "chunk", F.transform("theirs", lambda s: F.get("image", s)).alias("image"))
        known = known.where("not open").select("conv_id", "chunk", "image").unionByName(rerun)
        ahead *= 2


def _traced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, copies, right = (batch.column(n).to_pylist() for n in ("kinds", "copies", "right"))
        found = [trace(*c) for c in zip(kinds, copies, right)]
        kept = batch.drop_columns(["kinds", "copies", "right"])
        lists = [pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        columns = [pa.array(c, k) for c, k in zip(zip(*found) if found else [[]] * 3, lists)]
        yield pa.RecordBatch.from_arrays([*kept.columns, *columns], names=[*kept.schema.names, "audits", "costs", "ends"])


_FACTS = ["first_turn", "last_turn", "turns", "first_initial", "last_initial", "illegal", "blank", "duplicate", "truncated"]
_REPORT = pa.schema(
    [
        *((n, pa.int64()) for n in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        ("audit", pa.string()),
        ("repaired_sha256", pa.string()),
        ("chunks", pa.int64()),
    ]
)


class _Report:
    """One conversation: its chunks come first, in order, then its rows."""

    def __init__(self, conv_id):
        self.conv_id, self.state, self.cost, self.chunks = conv_id, 0, 0, 0
        self.audits, self.sum = [], dict.fromkeys(("turns", "illegal", "blank", "duplicate", "truncated"), 0)
        self.first_turn = self.last_turn = self.last_initial = None
        self.audit, self.at, self.roles, self.empty, self.sha = None, 0, 0, True, hashlib.sha256()

    def chunk(self, facts: dict):
        for name in self.sum:
            self.sum[name] += facts[name]
        if self.chunks:
            self.sum["illegal"] += illegal_pair(self.last_initial, facts["first_initial"])
        self.last_initial = facts["last_initial"]
        if facts["first_turn"] is not None:
            self.sum["turns"] -= facts["first_turn"] == self.last_turn
            self.first_turn = facts["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = facts["last_turn"]
        self.chunks += 1
        self.audits.append(facts["audits"][self.state])
        self.cost += facts["costs"][self.state]
        self.state = facts["ends"][self.state]

    def close_chunks(self):
        if self.audit is None:
            letters, cost = closing(self.state)
            self.audit, self.cost = "".join([*self.audits, letters]), self.cost + cost

    def emit(self, role: str, text: str):
        self.sha.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
        self.empty = False

    def inserts(self):
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.roles = _NEXT[self.roles]
            self.emit(ROLE[self.roles], "")

    def row(self, role: str, text: str | None, copies: int):
        self.close_chunks()
        self.inserts()
        letter = self.audit[self.at]
        self.at += copies
        if letter == "K":
            self.roles = _KEPT[role[:1]][self.roles]
            self.emit(role, text)
        elif letter == "R":
            self.roles = _NEXT[self.roles]
            self.emit(ROLE[self.roles], text)

    def result(self) -> tuple:
        self.close_chunks()
        self.inserts()
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.sum["turns"]
        counts = [self.sum[n] for n in ("blank", "duplicate", "truncated", "illegal")]
        return (self.conv_id, gaps, *counts, self.cost, self.audit, self.sha.hexdigest(), self.chunks)


def _reports(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    report = None
    for batch in batches:
        done = []
        for r in batch.to_pylist():
            if report is None or report.conv_id != r["conv_id"]:
                if report is not None:
                    done.append(report.result())
                report = _Report(r["conv_id"])
            if r["step"] == 1:
                report.chunk(r)
            elif r["step"] == 2:
                report.row(r["role"], r["text"], r["copies"])
        yield _batch(done, _REPORT)
    if report is not None:
        yield _batch([report.result()], _REPORT)


def repair(rows: DataFrame, conversations: DataFrame | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One report per conversation of `rows` (from `structure_rows`), and of `conversations` (conv_id) without any row.

    (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, chunks); a row's first fault counts.
    """
    chunks = _chunks(rows, chunk_rows)
    shapes = _true_shapes(chunks).select(F.col("conv_id").alias("c"), F.col("chunk").alias("at"), F.col("shape").alias("right"))
    placed = chunks.join(shapes, _same_chunk(chunks, shapes, 1), "left").select("conv_id", "chunk", *_FACTS, "kinds", "copies", F.coalesce("right", F.lit(END)).alias("right"))
    kept = ", ".join(f"{n} {dict(placed.dtypes)[n]}" for n in ("conv_id", "chunk", *_FACTS))
    traced = placed.mapInArrow(_traced, f"{kept}, audits array<string>, costs array<bigint>, ends array<int>")
    texts = rows.select(*_ORDER, F.when(~blank(F.col("text")), F.col("text")).alias("text"), "copies")
    parts = [traced.withColumn("step", F.lit(1)), texts.withColumn("step", F.lit(2))]
    if conversations is not None:
        parts.append(conversations.select(F.col("conv_id").cast("bigint")).distinct().withColumn("step", F.lit(0)))
    stream = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "step", "chunk", *_ORDER[1:])
    schema = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string, chunks bigint"
    return stream.select("conv_id", "step", *_FACTS, "audits", "costs", "ends", "role", "text", "copies").mapInArrow(_reports, schema)


def damage(conversations: DataFrame) -> DataFrame:
    """Faults planted by a hash of the row's place: dropped, emptied, without sentence ends, repeated, or said by the user."""
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    text, fault = F.coalesce("text", F.lit(" ")), F.col("fault")
    marked = conversations.select("conv_id", "turn", "role", "text", F.pmod(F.crc32(place.cast("binary")), F.lit(20)).alias("fault")).where("fault <> 0")
    return marked.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 3, 2).otherwise(1).alias("copies"),
    )
