"""Near copies by SimHash: fingerprints, BK-trees over shards that lose no link, connected components.

A document's fingerprint takes the XXH64 (seed 42) of its 3-word shingles, repeats included: a bit is 1 if more than
half of the hashes have it. Documents are linked at `radius` or fewer differing bits.

Shards instead of one tree: 64 bits fall into radius + 1 = 4 blocks, so two linked fingerprints agree on a whole block.
Each fingerprint goes to the 4 shards of its block values, and each shard is a BK-tree of its own inside one task. A
shard over `shard_limit` is dealt on by 4 blocks of the bits its members may still differ in, which again loses no pair;
after five such rounds at most 17 bits are free, so no shard can exceed 131,072 different fingerprints at any input
size.
Trees travel with their shard's key in a shuffle rather than in a broadcast, as their size follows the input.
A shard passes on a link only if it joins two groups, so links stay under 4 per fingerprint (more only for dealt shards).

Defined cases: null and empty texts and texts of white space have fingerprint zero and are linked like any other; fewer
than three words make one shingle; rows with a null doc_id get a fingerprint and the component of their group (null if
no row of it has an id); repeated rows are returned each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm import copies
from hourloom.llm.arrow import map_texts, utf8
from hourloom.llm.components import connected_components
from hourloom.llm.copies import SIMILARITY
from hourloom.llm.hamming import BKTree, majority_bits
from hourloom.session import materialize

RADIUS = 3
SHINGLE = 3
SEED = 42
SHARD_LIMIT = 2048


# --- fingerprints ---------------------------------------------------------------------------------------------------


def shingle_xxh64(text: bytes, size: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of every shingle of a UTF-8 text."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, seed)]
    starts = [0, *[e + 1 for e in ends]]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :])]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed 64-bit number."""

    def make():
        def apply(piece):
            rows = [shingle_xxh64(t, shingle) for t in utf8(piece, 1)]
            counts = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
            flat = np.fromiter((h for r in rows for h in r), dtype=np.uint64, count=int(counts.sum()))
            return pa.RecordBatch.from_arrays([piece.column(0), pa.array(majority_bits(flat, counts).view(np.int64))], names=["doc_id", "fp"])

        return apply

    return map_texts(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), ["doc_id"], "text", "doc_id bigint, fp bigint", make)


# --- shards and trees -----------------------------------------------------------------------------------------------


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shard_masks() -> list[list[int]]:
    """Per round four masks that share out all 64 bits; bit positions are read as three digits to the base 4."""
    digits = [(p // 16, p // 4 % 4, p % 4) for p in range(64)]
    rules = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 1), (1, 2, 3)]
    return [
        [sum(1 << p for p, d in enumerate(digits) if sum(w * x for w, x in zip(rule, d)) % 4 == part) for part in range(4)]
        for rule in rules
    ]


def shard_links(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links that span the groups of a shard: a link is passed on only if it joins two groups."""
    tree, parent = BKTree(), {}

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for value in values:
        if value in parent:
            continue
        parent[value] = value
        for other in tree.near(value, radius):
            a, b = top(value), top(other)
            if a != b:
                parent[a] = b
                yield value, other
        tree.add(value)


def _link_runs(batches: Iterable[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by shard; one shard at a time is held."""
    held, key = [], None

    def flush():
        pairs = list(shard_links(held, radius)) if len(held) > 1 else []
        if pairs:
            a, b = (np.array(x, dtype=np.uint64).view(np.int64) for x in zip(*pairs))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        masks, parts = (batch.column(i).to_numpy() for i in (0, 1))
        values = batch.column(2).to_numpy().view(np.uint64).tolist()
        cuts = np.flatnonzero((np.diff(masks) != 0) | (np.diff(parts) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            at = (masks[a], parts[a])
            if at != key:
                yield from flush()
                held, key = [], at
            held.extend(values[a:b])
    yield from flush()


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints that chains of `radius` or fewer differing bits connect."""
    if not 0 <= radius <= 3:
        raise ValueError("shards are dealt for a radius of 0 to 3")
    rounds = shard_masks()
    open_shards = nodes.select(F.lit(0).cast("bigint").alias("mask"), "fp")
    done = []
    for number, masks in enumerate(rounds):
        options = F.array(*[F.col("mask").bitwiseOR(F.lit(_signed(m)).cast("bigint")) for m in masks])
        dealt = open_shards.select(F.explode(options).alias("mask"), "fp").select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("part"), "fp")
        if number + 1 == len(rounds):
            done.append(dealt)
            break
        large = materialize(dealt.groupBy("mask", "part").count().where(F.col("count") > shard_limit).drop("count"), "shards")
        if large.isEmpty():
            done.append(dealt)
            break
        done.append(dealt.join(large, ["mask", "part"], "left_anti"))
        open_shards = materialize(dealt.join(large, ["mask", "part"], "left_semi").select("mask", "fp").distinct(), "shards")
    links = None
    for shards in done:
        partitions = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        sorted_shards = shards.repartition(partitions, "mask", "part").sortWithinPartitions("mask", "part", "fp")
        found = sorted_shards.mapInArrow(lambda batches: _link_runs(batches, radius), "a bigint, b bigint")
        links = found if links is None else links.unionByName(found)
    return links


def near_duplicates(
    docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, shard_limit: int = SHARD_LIMIT, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, fp, component_id, linked): the smallest doc_id reachable, and how many other fingerprints its group holds."""
    marked = materialize(fingerprints(docs, shingle, doc_id, text), "fingerprints")
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    groups = connected_components(fingerprint_links(nodes.select("fp"), radius, shard_limit), "a", "b")
    rooted = nodes.join(groups.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"), (F.count("*") - 1).alias("linked"))
    classes = materialize(rooted.join(lows, "root").select("fp", "component_id", "linked"), "classes")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id", "linked")


def keep_one_per_group(docs: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of every group of near copies (see `copies`) stays: the one with the smallest id, then the least row hash.

    A row is known by its id and a hash of all its columns, so rows that repeat an id with another text are rows of their
    own, and rows without an id take part (after those with one). Rows equal in all columns are one row.
    """
    row = "__row"
    while row in docs.columns:
        row += "_"
    rows = docs.withColumn(row, F.xxhash64(*docs.columns))
    kept = copies.least_rows(rows, [doc_id, row], text, similarity).select(F.col(doc_id).alias("__kept"), F.col(row).alias("__kept_row"))
    same = rows[doc_id].eqNullSafe(kept["__kept"]) & (rows[row] == kept["__kept_row"])
    return rows.join(kept, same, "left_semi").dropDuplicates([doc_id, row]).select(*docs.columns)
