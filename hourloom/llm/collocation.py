"""Phrase collocations by dynamic itemset counting over contiguous words.

A phrase's words follow one another within a piece of text (pieces end at `.,;:!?` and line ends; words are split at space
and tab; A-Z are lower-cased). Counting goes round the shards of the corpus in a cycle. In each step words and longer
phrases are counted side by side: a phrase of k + 1 words becomes active as soon as both its subphrases of k words have
reached the threshold in the counts so far, and leaves again after one full cycle, when every shard has been counted once.
The scan ends when a whole cycle has activated nothing.

Active phrases are known to the tasks by Bloom filters over the phrases that reached the threshold (all, and those of the
last cycle), of 16 bits per phrase and at most `FILTER_BYTES` each, so what is broadcast is bounded. A false alarm only
counts a phrase that cannot reach the threshold: counts are kept per shard, so each shard enters a total once, and totals
of frequent phrases are exact because their subphrases are frequent. A saturated filter costs time, not correctness.

Most pairs of words are rare although both words are frequent. A pass over all shards adds up their hashes in at most
`COUNTERS` places, a bound on every pair's count, and pairs whose bound stays below the threshold are not passed on. No pair
that reaches the threshold is lost; counters that have filled up only cost time.

Phrases are counted within slices of a few megabytes by 64-bit hash and byte length, then summed by Spark on their text.

Defined cases: null texts are empty; a null language is `und`; repeated rows count each; phrases never cross pieces;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.llm.arrow import bounded, lean
from hourloom.llm.words import _LOWER, Words, mixed, shingle_hashes
from hourloom.session import materialize

LONGEST = 4
THRESHOLD = 30
SHARDS = 2
TOP = 2000
FILTER_BYTES = 1 << 23
SLICE_BYTES = 1 << 22
PAGE_BYTES = 1 << 16
COUNTERS = 1 << 24
HASH_BYTES = 1 << 18
BATCH_PHRASES = 1 << 15

_PIECE_END = np.zeros(256, dtype=bool)
_PIECE_END[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _PIECE_END.copy()
_GAP[[32, 9]] = True


class Pieces:
    """Words of the texts of a slice, cleaned: every word followed by one space; `piece` numbers the piece of each."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary()).fill_null(b"")
        _, offsets, values = column.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        raw = np.frombuffer(values, dtype=np.uint8)[at[0] : at[-1]] if values is not None else np.zeros(0, np.uint8)
        at = at - at[0]
        data = _LOWER[raw]
        inside = np.zeros(len(data) + 2, dtype=bool)
        np.logical_not(_GAP[data], out=inside[1:-1])
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[at] = True
        start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
        end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
        breaks = np.zeros(len(data) + 1, dtype=np.int8)
        breaks[1:] = _PIECE_END[data]
        breaks[:-1] += edge[:-1]
        self.piece = np.cumsum(breaks, dtype=np.int32 if len(data) < 1 << 30 else np.int64)[start]
        self.row = np.searchsorted(at, start, side="right") - 1
        lengths = end - start
        self.end = np.cumsum(lengths + 1) - 1
        self.start = self.end - lengths
        self.data = np.full(int(self.end[-1]) + 1 if len(start) else 0, 32, dtype=np.uint8)
        letters = np.ones(len(self.data), dtype=bool)
        letters[self.end] = False
        self.data[letters] = data[inside[1:-1]]

    def hashes(self) -> np.ndarray:
        """Hash of every word, block by block."""
        out = np.empty(len(self.start), dtype=np.uint64)
        cuts = np.unique(np.append(np.searchsorted(self.start, np.arange(0, len(self.data), HASH_BYTES)), len(out))).tolist()
        for a, b in zip(cuts, cuts[1:]):
            low = self.start[a]
            out[a:b] = Words(self.data[low : self.end[b - 1]], self.start[a:b] - low, self.end[a:b] - low, np.array([0, b - a])).hashes()
        return out

    def texts(self, first: np.ndarray, size: int) -> pa.Array:
        """The phrases of `size` words from each place of `first` on."""
        low, high = self.start[first], self.end[first + size - 1]
        offsets = np.zeros(len(first) + 1, dtype=np.int64)
        np.cumsum(high - low, out=offsets[1:])
        data = self.data[_ranges(low, high - low)]
        return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())


def _ranges(start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... for `lengths[i]` places each, one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(start - before, lengths)


def _salted(phrases: np.ndarray, langs: np.ndarray) -> np.ndarray:
    return mixed(phrases ^ langs)


class PhraseFilter:
    """Bloom filter with two probes per 64-bit hash; no false negatives."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def probes(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(bits - 1)
        return hashes & mask, (hashes >> np.uint64(32)) & mask

    @classmethod
    def size(cls, phrases: int, most: int) -> int:
        """Bytes, a power of two: 16 bits per phrase, `most` at most."""
        return min(most, max(1024, 1 << (2 * phrases - 1).bit_length()))

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), dtype=bool)
        for probe in self.probes(hashes, len(self.bits) * 8):
            found &= (self.bits[(probe >> np.uint64(3)).astype(np.int64)] >> (probe & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def _lang_hashes(langs: list[str]) -> np.ndarray:
    known = {n: xxhash.xxh3_64_intdigest(n.encode()) for n in set(langs)}
    return np.array([known[n] for n in langs], dtype=np.uint64)


def _counted(keys: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and count of every run of equal (hash, byte length) in hash order."""
    order = np.argsort(keys, kind="stable")
    k, length = keys[order], lengths[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (length[1:] != length[:-1])
    heads = np.flatnonzero(new)
    return order[heads], np.diff(np.append(heads, len(order)))


_FOUND = pa.schema([("words", pa.int32()), ("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


def pair_bounds(source: DataFrame, most: int = COUNTERS) -> np.ndarray:
    """Occurrences of all pairs of words of `source` (lang, text), at most 255, added up by the low bits of their hashes."""
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    counters = min(most, max(1024, 1 << (size // 16).bit_length()))
    page = min(counters, PAGE_BYTES)

    def partial(batches):
        own = np.zeros(counters, dtype=np.uint8)
        for piece in bounded(batches, 1, SLICE_BYTES):
            pieces = Pieces(piece.column(1))
            _, keys = _active_phrases(pieces, pieces.hashes(), _lang_hashes(piece.column(0).to_pylist())[pieces.row], 2, None)
            places, n = np.unique(keys & np.uint64(counters - 1), return_counts=True)
            own[places] = np.minimum(own[places] + n, 255)
        pages = np.flatnonzero(own.reshape(-1, page).any(axis=1)).tolist()
        for p in pages:
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([own[p * page : (p + 1) * page].tobytes()], pa.binary())], names=["page", "counts"])

    def summed(batches):
        pages = {}
        for batch in batches:
            for p, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pages[p] = np.minimum(pages.get(p, np.uint16(0)) + np.frombuffer(counts, dtype=np.uint8).astype(np.uint16), 255).astype(np.uint16)
        packed = [c.astype(np.uint8).tobytes() for c in pages.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(pages), pa.int64()), pa.array(packed, pa.binary())], names=["page", "counts"])

    schema = "page bigint, counts binary"
    out = np.zeros(counters, dtype=np.uint8)
    for r in source.select("lang", "text").mapInArrow(lean(partial), schema).repartition("page").mapInArrow(lean(summed), schema).collect():
        out[r["page"] * page : (r["page"] + 1) * page] = np.frombuffer(r["counts"], dtype=np.uint8)
    return out


def _active_phrases(pieces: Pieces, words: np.ndarray, own: np.ndarray, size: int, reached: tuple[PhraseFilter, PhraseFilter] | None):
    """Places and hashes of the phrases of `size` words whose two subphrases pass the filters (all, and one of them lately)."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    at = np.flatnonzero(pieces.piece[:count] == pieces.piece[size - 1 :])
    if reached is not None:
        shorter = _salted(shingle_hashes(words, size - 1), own)
        every, lately = reached
        passed = lately(shorter)
        at = at[passed[at] | passed[at + 1]]
        at = at[every(shorter[at]) & every(shorter[at + 1])]
    return at, _salted(shingle_hashes(words, size)[at], own[at])


def _count(
    batches: Iterable[pa.RecordBatch], filters: dict[int, tuple[PhraseFilter, PhraseFilter] | None], bounds: np.ndarray | None = None, threshold: int = THRESHOLD
) -> Iterator[pa.RecordBatch]:
    """(words, lang, phrase, n) within every slice; words 0 stands for all words of a language. `bounds` as from `pair_bounds`."""
    for piece in bounded(batches, 1, SLICE_BYTES):
        names = piece.column(0).to_pylist()
        pieces = Pieces(piece.column(1))
        words, own, langs = pieces.hashes(), _lang_hashes(names)[pieces.row], pa.array(names, pa.string())
        for size, reached in filters.items():
            at, keys = _active_phrases(pieces, words, own, size, reached)
            if size == 2 and bounds is not None:
                enough = bounds[keys & np.uint64(len(bounds) - 1)] >= min(threshold, 255)
                at, keys = at[enough], keys[enough]
            first, n = _counted(keys, pieces.end[at + size - 1] - pieces.start[at])
            at = at[first]
            for low in range(0, len(at), BATCH_PHRASES):
                some = at[low : low + BATCH_PHRASES]
                sizes = pa.array(np.full(len(some), size, dtype=np.int32))
                columns = [sizes, langs.take(pa.array(pieces.row[some])), pieces.texts(some, size), pa.array(n[low : low + BATCH_PHRASES])]
                yield pa.RecordBatch.from_arrays(columns, schema=_FOUND)
        if 1 in filters:
            n = np.bincount(pieces.row, minlength=len(names))
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(names), pa.int32()), langs, pa.array([""] * len(names)), pa.array(n)], schema=_FOUND)


def _filter_bits(reached: DataFrame, sizes: dict[tuple[int, bool], int]) -> dict[tuple[int, bool], PhraseFilter]:
    """A filter per (words, lately) of `sizes`, which holds its bytes; tasks set the bits of pages of at most 64 KB."""

    def probes(batches):
        for batch in bounded(batches, 1, SLICE_BYTES):
            words, late = batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            for (size, lately), length in sizes.items():
                own = batch.filter(pa.array((words == size) & (late | (not lately))))
                whole = shingle_hashes(Pieces(own.column(1)).hashes(), size)[::size]
                places = np.concatenate(PhraseFilter.probes(_salted(whole, _lang_hashes(own.column(0).to_pylist())), length * 8)).astype(np.int64)
                page = min(length, PAGE_BYTES) * 8
                columns = [pa.array(np.full(len(places), v)) for v in (size, lately)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(places // page), pa.array(places % page)], names=["words", "lately", "page", "place"])

    def pages(batches):
        bits = {}
        for batch in batches:
            for key in set(zip(*(batch.column(i).to_pylist() for i in range(3)))):
                chosen = reduce(np.logical_and, [batch.column(i).to_numpy(zero_copy_only=False) == v for i, v in enumerate(key)])
                place = batch.column(3).to_numpy()[chosen]
                own = bits.setdefault(key, np.zeros(min(sizes[key[:2]], PAGE_BYTES), dtype=np.uint8))
                np.bitwise_or.at(own, place >> 3, (1 << (place & 7)).astype(np.uint8))
        columns = [pa.array([k[i] for k in bits], t) for i, t in enumerate([pa.int64(), pa.bool_(), pa.int64()])]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([b.tobytes() for b in bits.values()], pa.binary())], names=["words", "lately", "page", "bits"])

    schema = "words bigint, lately boolean, page bigint"
    placed = reached.mapInArrow(lean(probes), schema + ", place bigint").repartition("words", "lately", "page")
    found = {key: np.zeros(length, dtype=np.uint8) for key, length in sizes.items()}
    for r in placed.mapInArrow(lean(pages), schema + ", bits binary").collect():
        page = np.frombuffer(r["bits"], dtype=np.uint8)
        found[r["words"], r["lately"]][r["page"] * len(page) : (r["page"] + 1) * len(page)] = page
    return {key: PhraseFilter(bits) for key, bits in found.items()}


def _filters(counted: DataFrame | None, step: int, longest: int, shards: int, filter_bytes: int) -> dict[int, tuple[PhraseFilter, PhraseFilter] | None]:
    """What is active in a step: words in the first cycle, and phrases with a subphrase that reached the threshold in the last one."""
    active: dict[int, tuple[PhraseFilter, PhraseFilter] | None] = {1: None} if step < shards else {}
    if counted is None:
        return active
    late = (F.col("reached") >= step - shards).alias("late")
    reached = counted.where(F.col("reached").isNotNull() & F.col("words").between(1, longest - 1)).select("lang", "phrase", "words", late)
    sizes = {}
    for r in reached.groupBy("words").agg(F.count("*").alias("every"), F.count_if("late").alias("lately")).collect():
        if r["lately"]:
            sizes |= {(r["words"], False): r["every"], (r["words"], True): r["lately"]}
    if not sizes:
        return active
    found = _filter_bits(reached, {key: PhraseFilter.size(n, filter_bytes) for key, n in sizes.items()})
    return active | {words + 1: (found[words, False], found[words, True]) for words in sorted({w for w, _ in sizes})}


def _merged(before: DataFrame | None, seen: DataFrame, step: int, shards: int, threshold: int) -> DataFrame:
    """Counts per shard after a step, with the step in which their sum reached the threshold.

    A row that was counted in all other shards before has its whole count now: the step's shard was either counted or, if
    the phrase is not active, is counted with all others when it becomes so. Below the threshold it is no longer needed.
    """
    names = [f"n{s}" for s in range(shards)]
    own = f"n{step % shards}"
    none = F.lit(None).cast("bigint")
    rows = seen.select("words", "lang", "phrase", *[(F.col("n") if n == own else none).alias(n) for n in names], F.lit(None).cast("int").alias("reached"), none.alias("known"))
    if before is not None:
        rows = before.withColumn("known", F.col(own)).unionByName(rows)
    # A shard that was counted before keeps its count.
    now = F.coalesce(F.max("known"), F.sum(own)).alias(own)
    rows = rows.groupBy("words", "lang", "phrase").agg(*[now if n == own else F.max(n).alias(n) for n in names], F.min("reached").alias("reached"))
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(n), F.lit(0)) for n in names])
    others = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names if n != own], F.lit(True))
    rows = rows.withColumn("reached", F.when(total >= threshold, F.coalesce("reached", F.lit(step))))
    return rows.where((F.col("words") == 0) | (total >= threshold) | ~others)


def _counter(filters, bounds, threshold: int):
    """`_count` in a task, with what is broadcast."""
    return lambda batches: _count(batches, filters.value, None if bounds is None else bounds.value, threshold)


def count_phrases(
    docs: DataFrame,
    longest: int = LONGEST,
    threshold: int = THRESHOLD,
    shards: int = SHARDS,
    filter_bytes: int = FILTER_BYTES,
    text: str = "text",
    lang: str = "lang",
    counters: int = COUNTERS,
) -> DataFrame:
    """(lang, phrase, words, n) of all phrases that occur `threshold` times in their language; words 0: all words of it."""
    spark = docs.sparkSession
    source = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(*docs.columns), F.lit(shards)).alias("shard"))
    source = materialize(source.where(F.octet_length("text") > 0), "texts")
    bounds = spark.sparkContext.broadcast(pair_bounds(source.select("lang", "text"), counters))
    counted, step = None, 0
    while active := _filters(counted, step, longest, shards, filter_bytes):
        shipped = spark.sparkContext.broadcast(active)
        shard = source.where(F.col("shard") == step % shards).select("lang", "text")
        run = _counter(shipped, bounds if 2 in active else None, threshold)
        seen = shard.mapInArrow(lean(run), "words int, lang string, phrase string, n bigint")
        counted = materialize(_merged(counted, seen, step, shards, threshold), "counted")
        shipped.destroy()
        step += 1
    bounds.destroy()
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"n{s}"), F.lit(0)) for s in range(shards)])
    return counted.where((F.col("words") == 0) | (total >= threshold)).select("lang", "phrase", "words", total.alias("n"))


def collocations(counts: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases that no longer phrase explains.

    A phrase is explained by a longer one that holds its words and has at least four fifths of its count. Its score is
    that of its weakest cut in two.
    """
    counts = materialize(counts, "frequent")
    frequent, words = counts.where("words > 0"), counts.where("words = 0").select("lang", "n")
    split = frequent.withColumn("w", F.split("phrase", " "))
    longer = split.where("words > 2").select("lang", "n", F.explode(_parts_inside(F.col("w"), F.col("words"))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    candidates = frequent.where("words > 1").join(longer, ["lang", "phrase"], "left")
    candidates = candidates.where("most is null or 5 * cast(most as decimal(20,0)) < 4 * cast(n as decimal(20,0))")
    candidates = candidates.select("lang", "phrase", F.split("phrase", " ").alias("w"), "words", F.col("n").alias("a"))
    cuts = candidates.select("lang", "phrase", "a", "words", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", _joined(F.slice("w", F.lit(1), F.col("k"))).alias("head"), _joined(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k"))).alias("rest")
    )
    left, right = (frequent.select("lang", F.col("phrase").alias(part), F.col("n").alias(count)) for part, count in (("head", "l"), ("rest", "r")))
    cuts = cuts.join(left, ["lang", "head"]).join(right, ["lang", "rest"])
    whole = "cast(2000000 * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as bigint)"
    weakest = F.min(F.struct(F.expr(whole).alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a").agg(weakest).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(words, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def _parts_inside(words: Column, count: Column) -> Column:
    """Phrases of 2 to count - 1 words that lie in the phrase."""

    def of_size(size):
        starts = F.sequence(F.lit(1), count - size + 1)
        return F.transform(starts, lambda at: _joined(F.slice(words, at, size)))

    return F.flatten(F.transform(F.sequence(F.lit(2), count - 1), of_size))
