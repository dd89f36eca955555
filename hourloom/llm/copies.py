"""Near copies by SimHash and BK-trees over shards, decided by their shingle sets; groups by alternating stars.

Two texts are near copies if the sets of their 5-word shingles (A-Z lower-cased) have a Jaccard similarity of at least
0.8; groups are chains of such pairs. A text is known by its shingle set, so texts with equal sets are one node at once.

1. Fingerprints: a node has the SimHash of its set. A pair at 0.8 differs in 9.7 of 64 bits on average and in more than
   `RADIUS` with probability 1e-8 (1e-6 for four shingles against five, the worst case).
2. Shards: that radius leaves blocks of two bits, which split nothing, so shards are dealt by `BANDS` MinHash keys, each made
   of `ROWS` least values under as many hash orders. A pair at similarity s shares none with probability
   (1 - s ** 4) ** 30: 2.4e-12 at 0.9, 2.3e-7 at 0.8. Members of a shard over `SHARD_LIMIT` are dealt on: two sets of
   similarity 0.8 share a shingle among the first n - ceil(0.8 n) + 1 of each, in whatever common order, so they go to the
   shards of their rarest shingles, by a sketch of a fixed number of counters; a coarse count only makes keys less rare.
   Texts that only share a template or a common passage no longer meet there.
3. BK-trees: each shard is a tree over its fingerprints in one task and finds the pairs within the radius. At this width it
   prunes little, so pairs are also left out if their sizes or their parity marks rule out 0.8. A mark has `64 * MARKS`
   bits, each the parity of the shingles that fall on it, so two marks never differ in more bits than their sets differ in
   shingles: nothing similar is left out. When a shard is searched again, its members bring `64 * WIDE` bits as well, which tell long
   texts apart too, so that its links are nearly only similar pairs and not all pairs of texts that share a good part.
4. Sets decide all pairs found that wider marks do not rule out. A shard of many members passes on links that span its
   groups; if all of them are similar, no other link can matter. Otherwise it is searched again, in the end for all its
   pairs, so no link is lost.
5. Alternating stars make the groups.

Defined cases: fewer than five words make one shingle; texts without a word have no shingle and are one group among
the rows with an id and one among those without; sets and shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm.arrow import bounded, lean, map_texts
from hourloom.llm.components import connected_components
from hourloom.llm.hamming import BKTree, Groups, majority_bits, tree_pairs
from hourloom.llm.words import mixed, shingle_hashes, split_words
from hourloom.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 30
ROWS = 4
STAR_ROUNDS = 2
PAIRS_PER_MEMBER = 4
RADIUS = 28
SHARD_LIMIT = 2048
FEW = 32
PARTNERS = 256
WIDE = 64
COUNTERS = 1 << 21
MARKS = 4
PAGE = 1 << 16
_FACTORS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted hashes of the different shingles of every text; none for null texts and texts without a word."""
    words = split_words(column)
    hashes = words.hashes()
    rolled = shingle_hashes(hashes, size)
    out = []
    for a, b in zip(words.first.tolist(), words.first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        else:
            out.append(shingle_hashes(hashes[a:b], b - a)[:1])
    return out


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(set, band): signed keys of non-empty sets."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    keys = np.zeros((len(sets), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        for row in range(ROWS):
            least = np.minimum.reduceat(flat * _FACTORS[band * ROWS + row], starts)
            keys[:, band] = mixed(keys[:, band] + least + np.uint64(band * ROWS + row + 1))
    return keys.view(np.int64)


def node_of(shingles: np.ndarray) -> int:
    x = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return x - (1 << 64) if x >> 63 else x


WIDE_BLOCK = 1 << 13
_MARKED = [f"mark{i}" for i in range(MARKS)]
_MEMBER = ["node", "n", "fp", *_MARKED]


def _longs(names: list[str]) -> str:
    return ", ".join(f"{c} bigint" for c in names)


def traits(sets: list[np.ndarray]) -> np.ndarray:
    """(set, column): size, fingerprint and parity marks of non-empty sets."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    fingerprints = majority_bits(mixed(np.concatenate(sets)), sizes)
    return np.column_stack([sizes, fingerprints.view(np.int64), parity_marks(sets)])


def marked_rows(docs: DataFrame, own: list[str], text: str) -> DataFrame:
    """`own` columns of every row, the node of its text (null without a word), its traits and the node's keys."""
    schema = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in own)

    def make():
        def apply(piece):
            sets = shingle_sets(piece.column(len(own)))
            full = [i for i, s in enumerate(sets) if len(s)]
            keys, nodes = [[] for _ in sets], [None] * len(sets)
            known = np.zeros((len(sets), len(_MEMBER) - 1), dtype=np.int64)
            for i, k in zip(full, band_keys([sets[i] for i in full]).tolist() if full else []):
                nodes[i], keys[i] = node_of(sets[i]), k
            if full:
                known[full] = traits([sets[i] for i in full])
            columns = [*(piece.column(i) for i in range(len(own))), pa.array(nodes, pa.int64())]
            columns += [pa.array(np.ascontiguousarray(c)) for c in known.T]
            return pa.RecordBatch.from_arrays([*columns, pa.array(keys, pa.list_(pa.int64()))], names=[*own, *_MEMBER, "keys"])

        return apply

    return map_texts(docs, own, text, f"{schema}, {_longs(_MEMBER)}, keys array<bigint>", make)


def sets_of(texts: DataFrame) -> DataFrame:
    """(node, shingles): the set of every text, as bytes."""

    def run(batches):
        for piece in bounded(batches, 0):
            sets = shingle_sets(piece.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

    return texts.mapInArrow(lean(run), "node bigint, shingles binary")


def shingle_sketch(sets: DataFrame, counters: int = COUNTERS) -> np.ndarray:
    """How often shingles occur in `sets`, added up in `counters` places by the low bits of their hashes."""
    page = min(PAGE, counters)

    def partial(batches):
        own = np.zeros(counters, dtype=np.int64)
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint64)
            own += np.bincount((flat & np.uint64(counters - 1)).astype(np.int64), minlength=counters)
        own = np.minimum(own, 255).astype(np.uint8)
        pages = np.flatnonzero(own.reshape(-1, page).any(axis=1)).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array([own[p * page : (p + 1) * page].tobytes() for p in pages], pa.binary())], names=["page", "counts"])

    def summed(batches):
        pages = {}
        for batch in batches:
            for p, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pages[p] = pages.get(p, 0) + np.frombuffer(counts, dtype=np.uint8).astype(np.int64)
        packed = [np.minimum(c, 65_535).astype(np.uint16).tobytes() for c in pages.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(pages), pa.int64()), pa.array(packed, pa.binary())], names=["page", "counts"])

    schema = "page bigint, counts binary"
    out = np.zeros(counters, dtype=np.uint16)
    for r in sets.select("shingles").mapInArrow(lean(partial), schema).repartition("page").mapInArrow(lean(summed), schema).collect():
        out[r["page"] * page : (r["page"] + 1) * page] = np.frombuffer(r["counts"], dtype=np.uint16)
    return out


def prefix_keys(shingles: np.ndarray, sketch: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest shingles of a set, one of which every set of that similarity has among its own rarest."""
    counts = sketch[(shingles & np.uint64(len(sketch) - 1)).astype(np.int64)]
    n = len(shingles)
    return shingles[np.lexsort((shingles, counts))[: n - int(np.ceil(similarity * n - 1e-9)) + 1]]


def parity_marks(sets: list[np.ndarray], marks: int = MARKS) -> np.ndarray:
    """(set, word): bits that are set where an odd number of shingles falls, for non-empty sets."""
    flat = np.concatenate(sets)
    place = (flat >> np.uint64(40)) % np.uint64(64 * marks)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bits = np.bincount(owner * (64 * marks) + place.astype(np.int64), minlength=len(sets) * 64 * marks) & 1
    return np.packbits(bits.astype(np.uint8).reshape(len(sets), -1), axis=1, bitorder="little").view(np.int64)


def prefix_members(sets: DataFrame, sketch: np.ndarray, similarity: float) -> DataFrame:
    """Every node with its root and traits under its prefix shingles."""
    shipped = sets.sparkSession.sparkContext.broadcast(sketch)

    def run(batches):
        for batch in bounded(batches, 2):
            own = [np.frombuffer(s, dtype=np.uint64) for s in batch.column(2).to_pylist()]
            found = [prefix_keys(s, shipped.value, similarity) for s in own]
            lengths = np.array([len(f) for f in found], dtype=np.int64)
            known = np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy(), traits(own)])
            columns = [np.concatenate(found).view(np.int64), *np.repeat(known, lengths, axis=0).T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["key", "root", *_MEMBER])

    return sets.select("root", "node", "shingles").mapInArrow(lean(run), _longs(["key", "root", *_MEMBER]))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def pairs_that(pairs: DataFrame, held: DataFrame, decide: Callable[[bytes, bytes], bool]) -> DataFrame:
    """The pairs (a, b) for which `decide` says true of what `held` (node, value) holds of both.

    The value of `a` travels once for every part of its partners, followed by their values.
    """

    def run(batches):
        head, at = None, None
        for batch in batches:
            found = [], []
            for a, part, b, value in zip(*(batch.column(n).to_pylist() for n in ("a", "part", "b", "value"))):
                if b is None:
                    head, at = value, (a, part)
                elif at == (a, part) and decide(head, value):
                    found[0].append(a)
                    found[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["a", "b"])

    partners = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("parts"))
    parted = pairs.join(partners, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    heads = parted.select("a", F.lit(None).cast("bigint").alias("b"), "part", F.col("a").alias("node")).distinct()
    both = heads.unionByName(parted.withColumn("node", F.col("b"))).join(held, "node")
    ordered = both.select("a", "part", "b", "value").repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    return ordered.mapInArrow(lean(run), "a bigint, b bigint")


def wide_marks(sets: DataFrame) -> DataFrame:
    """(node, value): the size of every set and `64 * WIDE` parity bits, as bytes; they tell long texts apart as well."""

    def run(batches):
        for batch in bounded(batches, 1):
            own = [np.frombuffer(s, dtype=np.uint64) for s in batch.column(1).to_pylist()]
            values = [np.append(len(s), parity_marks([s], WIDE)[0]).tobytes() for s in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.binary())], names=["node", "value"])

    return sets.select("node", "shingles").mapInArrow(lean(run), "node bigint, value binary")


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are at least that similar; sets travel only for pairs that wide marks do not rule out."""

    def may_be(a, b):
        a, b = (np.frombuffer(v, dtype=np.int64) for v in (a, b))
        differing = int(np.bitwise_count((a[1:] ^ b[1:]).view(np.uint64)).sum())
        return differing <= (a[0] + b[0]) * (1 - 2 * similarity / (1 + similarity)) + 1e-6

    def are(a, b):
        return jaccard(*(np.frombuffer(v, dtype=np.uint64) for v in (a, b))) >= similarity

    left = materialize(pairs_that(pairs, wide_marks(sets), may_be), "pairs")
    return pairs_that(left, sets.withColumnRenamed("shingles", "value"), are)


def may_be_similar(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """False where the sizes or the parity marks of members rule out the similarity; rows and columns as in `traits`."""
    n, m = a[:, 0], b[:, 0]
    shared = similarity / (1 + similarity) * (n + m) - 1e-6
    differing = np.bitwise_count(a[:, 2:].view(np.uint64) ^ b[:, 2:].view(np.uint64)).sum(axis=1, dtype=np.int64)
    return (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9) & (differing <= n + m - 2 * shared)


def may_be_by_wide_marks(sizes: np.ndarray, wide: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs (places i, j) the wide marks of members do not rule out; all of them if members bring none."""
    good = np.ones(len(i), dtype=bool)
    for low in range(0, len(i) if wide.shape[1] else 0, WIDE_BLOCK):
        a, b = i[low : low + WIDE_BLOCK], j[low : low + WIDE_BLOCK]
        differing = np.bitwise_count(wide[a] ^ wide[b]).sum(axis=1, dtype=np.int64)
        good[low : low + WIDE_BLOCK] = differing <= (sizes[a] + sizes[b]) * (1 - 2 * similarity / (1 + similarity)) + 1e-6
    return good


def tree_links(known: np.ndarray, wide: np.ndarray, roots: np.ndarray, similarity: float, pairs_per_member: int | None) -> tuple[list, list, bool]:
    """Pairs (places i, j) of one shard that its BK-tree finds and whose traits may be similar, between different roots.

    All of them if they can be no more than `pairs_per_member` (None: without bound) per member; else links that span
    the groups which all of them would make. Says whether some were left out.
    """
    size = len(known)
    whole = pairs_per_member is None or size * (size - 1) <= 2 * pairs_per_member * size
    values, groups = np.ascontiguousarray(known[:, 1]).view(np.uint64), Groups(roots)
    out = [], []
    for i, j in tree_pairs(values, RADIUS, groups.label):
        good = may_be_similar(known[i], known[j], similarity)
        i, j = i[good], j[good]
        good = may_be_by_wide_marks(known[:, 0], wide, i, j, similarity)
        i, j = i[good], j[good]
        if not whole and len(i):
            kept = groups.spanning(i, j)
            i, j = i[kept], j[kept]
        out[0].extend(i.tolist())
        out[1].extend(j.tolist())
    return *out, not whole


def small_tree_links(known: np.ndarray, wide: np.ndarray, roots: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """All pairs of `tree_links` for a shard of few members."""
    tree, places, found = BKTree(), {}, []
    for j, value in enumerate(known[:, 1].view(np.uint64).tolist()):
        found += [(i, j) for near in tree.near(value, RADIUS) for i in places[near] if roots[i] != roots[j]]
        places.setdefault(value, []).append(j)
        tree.add(value)
    if found:
        i, j = np.array(found).T
        may_be = may_be_similar(known[i], known[j], similarity) & may_be_by_wide_marks(known[:, 0], wide, i, j, similarity)
        found = [pair for pair, good in zip(found, may_be) if good]
    return found


def shard_links(members: DataFrame, similarity: float, pairs_per_member: int | None, number: int = 0, shard_limit: int | None = None) -> DataFrame:
    """(key, a, b, partial): pairs that the BK-trees of the shards (equal `key`) find; see `tree_links`.

    Each member of a shard over `shard_limit` comes back alone, with b null. `number` varies which links span a shard.
    Members may bring their wide marks in a column `value` (see `wide_marks`).
    """
    own = ["key", "root", *_MEMBER]

    def of_shards(table):
        table = table[np.flatnonzero(_shared(table[:, 0]))]
        cuts = np.flatnonzero(np.diff(table[:, 0])) + 1
        out = [], [], [], []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(table)]):
            nodes, roots, known = table[a:b, 2], table[a:b, 1], np.ascontiguousarray(table[a:b, 3 : len(own)])
            wide = table[a:b, len(own) :].view(np.uint64)
            if shard_limit is not None and b - a > shard_limit:
                i, right, partial = np.arange(b - a), [None] * (b - a), False
            else:
                if b - a <= FEW and (pairs_per_member is None or b - a - 1 <= 2 * pairs_per_member):
                    pairs, partial = small_tree_links(known, wide, roots, similarity), False
                    i, j = [p[0] for p in pairs], [p[1] for p in pairs]
                else:
                    i, j, partial = tree_links(known, wide, roots, similarity, pairs_per_member)
                right = nodes[j].tolist() if len(j) else []
            if not len(i):
                continue
            left = nodes[i].tolist()
            out[0].extend([int(table[a, 0])] * len(left))
            out[1].extend(left if right[0] is None else map(min, left, right))
            out[2].extend(right if right[0] is None else map(max, left, right))
            out[3].extend([partial] * len(left))
        types = [pa.int64()] * 3 + [pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["key", "a", "b", "partial"])

    def run(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.column_stack([c.to_numpy() for c in batch.columns[: len(own)]])
            if batch.num_columns > len(own):  # the size, then the words of the marks
                wide = np.frombuffer(b"".join(batch.column(len(own)).to_pylist()), dtype=np.int64)
                table = np.hstack([table, wide.reshape(len(table), -1)[:, 1:]])
            goes_on = held and table[-1, 0] == held[0][0, 0]
            held.append(table)
            if not goes_on:
                table = np.concatenate(held)
                last = np.searchsorted(table[:, 0], table[-1, 0])
                held = [table[last:]]
                yield of_shards(table[:last])
        if held:
            yield of_shards(np.concatenate(held))

    # The number is given, so that few rows are not gathered in one task.
    partitions = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.select(*own, *(c for c in members.columns if c == "value")).repartition(partitions, "key")
    ordered = dealt.sortWithinPartitions("key", F.xxhash64("node", F.lit(number)), "node")
    return ordered.mapInArrow(lean(run), "key bigint, a bigint, b bigint, partial boolean")


def _shared(keys: np.ndarray) -> np.ndarray:
    """Which of the sorted keys occur more than once."""
    same = np.zeros(len(keys) + 1, dtype=bool)
    same[1:-1] = keys[1:] == keys[:-1]
    return same[1:] | same[:-1]


def node_links(nodes: DataFrame, found: DataFrame, sets: DataFrame, similarity: float, star_rounds: int, pairs_per_member: int) -> DataFrame:
    """(node, root) of the components that all similar pairs make; `found` as from `shard_links` for all shards.

    A shard whose spanning links all turned out similar is done. The others are searched again with the groups that are
    known by then, and after `star_rounds` rounds for all their pairs between different groups.
    """
    links, members, number, wide = None, None, 0, None
    while True:
        pairs = materialize(found.select("a", "b").distinct(), "pairs")
        similar = materialize(similar_pairs(pairs, sets, similarity), "similar")
        links = similar if links is None else links.unionByName(similar)
        partial = found.where("partial")
        unlike = partial.join(similar, ["a", "b"], "left_anti").select("key").distinct()
        if members is None:  # nothing was one group yet, so the links of a shard hold all its members that may have partners
            members = partial.select("key", F.explode(F.array("a", "b")).alias("node")).distinct()
        members = materialize(members.join(unlike, "key", "left_semi"), "open_members")
        roots = connected_components(links, "a", "b")
        if members.isEmpty():
            return roots
        number += 1
        if wide is None:
            wide = materialize(wide_marks(sets.join(members.select("node").distinct(), "node", "left_semi")), "marks")
        marked = members.join(nodes.select(*_MEMBER), "node").join(wide, "node")
        rooted = marked.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        found = materialize(shard_links(rooted, similarity, pairs_per_member if number < star_rounds else None, number), "links")


def least_rows(
    docs: DataFrame,
    own: list[str],
    text: str = "text",
    similarity: float = SIMILARITY,
    star_rounds: int = STAR_ROUNDS,
    pairs_per_member: int = PAIRS_PER_MEMBER,
    shard_limit: int = SHARD_LIMIT,
) -> DataFrame:
    """`own` columns of the least row of every group of near copies; `own` tells rows apart, its nulls come last."""
    marked = marked_rows(docs, own, text)
    wordless = F.when(F.col(own[0]).isNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    marked = marked.withColumn("node", F.coalesce("node", wordless))
    rank = F.struct(*[f(c) for c in own for f in (lambda c: F.col(c).isNull().alias(f"{c}_null"), F.col)])
    same_for_all = [F.first(c).alias(c) for c in (*_MEMBER[1:], "keys")]
    nodes = materialize(marked.groupBy("node").agg(F.min(rank).alias("low"), *same_for_all), "nodes")
    at_once = pairs_per_member if star_rounds > 0 else None
    postings = nodes.select(F.explode("keys").alias("key"), F.col("node").alias("root"), *_MEMBER)
    found = materialize(shard_links(postings, similarity, at_once, shard_limit=shard_limit), "links")
    met = found.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct()
    asked = nodes.join(met, "node", "left_semi").select(*[F.col(f"low.{c}").alias(f"__{c}") for c in own])
    same = [docs[c].eqNullSafe(asked[f"__{c}"]) for c in own]
    texts = docs.join(asked, same, "left_semi").dropDuplicates(own).select(text)
    sets = materialize(sets_of(texts), "sets")
    crowded = materialize(found.where("b is null").select(F.col("a").alias("node"), F.col("a").alias("root")).distinct(), "crowded")
    if not crowded.isEmpty():
        own_sets = materialize(sets.join(crowded, "node"), "sets")
        members = prefix_members(own_sets, shingle_sketch(own_sets), similarity)
        found = found.where("b is not null").unionByName(materialize(shard_links(members, similarity, at_once), "links"))
    groups = node_links(nodes, found, sets, similarity, star_rounds, pairs_per_member)
    rooted = nodes.select("node", "low").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return rooted.groupBy("root").agg(F.min("low").alias("low")).select(*[f"low.{c}" for c in own])
