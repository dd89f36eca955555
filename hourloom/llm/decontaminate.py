"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming blocks, exact similarity.

A window has as many words as an item (the whole document if that is shorter). Its fingerprint has a bit where more than
half of its 5-word shingles, repeats included, have it. Fingerprints fall into radius + 1 blocks; a window within
`radius` bits of an item agrees with it on a whole block, so the block index finds every such item of that size. Each
candidate within the radius is verified by weighted Jaccard similarity (sum of smaller over sum of larger counts) of the
shingles' words; at least `similarity` makes a match.

A window can only reach a similarity above zero if it shares a shingle with the item, so windows are laid just around
shingles that some item holds; this skips no match. Items come in blocks of bounded bytes, one pass over the documents
each, so what a pass sends to the executors has a fixed bound.

Defined cases: null or wordless items and documents match nothing; an item of fewer than five words has one shingle, all
its words; repeated rows are reported each; of several windows the most similar counts, ties to the earliest.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm.arrow import filter_rows, map_texts
from hourloom.llm.words import Words, shingle_hashes, split_words

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 18
ITEM_BYTES = 4 << 20
SCHEMA = "doc_id bigint, item_id bigint, similarity double, distance int, word_start int, word_count int"
_GATE_BITS = 22
_STRETCH = 1 << 15


def word_list(words: Words, text: int) -> list[bytes]:
    span = slice(words.first[text], words.first[text + 1])
    starts, ends = words.start[span].tolist(), words.end[span].tolist()
    if not starts:
        return []
    data, low = words.data[starts[0] : ends[-1]].tobytes(), starts[0]
    return [data[a - low : b - low] for a, b in zip(starts, ends)]


def weighted_jaccard(a: list[bytes], b: list[bytes], size: int) -> float:
    """Similarity of the shingle counts of two word lists, each of at least `size` words."""
    x, y = (Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) for w in (a, b))
    shared = sum((x & y).values())
    total = x.total() + y.total() - shared
    return shared / total if total else 0.0


def window_fingerprints(hashes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Majority fingerprint of the `width` hashes from each start on."""
    out = np.zeros(len(starts), dtype=np.uint64)
    for at in range(0, len(starts), _STRETCH):
        part = starts[at : at + _STRETCH]
        cuts = np.flatnonzero(np.diff(part) > width) + 1
        for run in np.split(part, cuts):
            low = run[0]
            bits = np.unpackbits(hashes[low : run[-1] + width].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums = np.zeros((len(bits) + 1, 64), dtype=np.int32)
            np.cumsum(bits, axis=0, out=sums[1:])
            most = 2 * (sums[run - low + width] - sums[run - low]) > width
            out[np.searchsorted(starts, run)] = np.packbits(most, axis=1, bitorder="little").view("<u8").ravel()
    return out


class HammingBlocks:
    """Multi-index over fingerprints: all of them within `radius` of a query agree with it on one of radius + 1 blocks."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = []
        for low, high in zip(edges, edges[1:]):
            values = self._block(prints, low, high)
            order = np.argsort(values, kind="stable")
            self.blocks.append((low, high, values[order], order))

    @staticmethod
    def _block(prints, low, high):
        return (prints >> np.uint64(low)) & np.uint64((1 << int(high - low)) - 1)

    def within(self, queries: np.ndarray) -> list[tuple[int, int, int]]:
        """(query, fingerprint, distance) of every pair within the radius."""
        pairs = []
        for low, high, values, order in self.blocks:
            asked = self._block(queries, low, high)
            a, b = np.searchsorted(values, asked, "left"), np.searchsorted(values, asked, "right")
            n = b - a
            q = np.repeat(np.arange(len(queries)), n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
            pairs.append(q * len(self.prints) + order[place])
        pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        q, k = np.divmod(pairs, max(1, len(self.prints)))
        d = np.bitwise_count(queries[q] ^ self.prints[k])
        keep = d <= self.radius
        return list(zip(q[keep].tolist(), k[keep].tolist(), d[keep].tolist()))


class ItemIndex:
    """The items of one block, by their size in words."""

    def __init__(self, items: list[tuple[int | None, str | None]], radius: int, similarity: float, shingle: int):
        self.radius, self.similarity = radius, similarity
        table = split_words(pa.array([t for _, t in items], type=pa.large_string()))
        hashes = table.hashes()
        self.words = [word_list(table, i) for i in range(len(items))]
        self.ids = [i for i, _ in items]
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(self.words):
            if w:
                by_size.setdefault(len(w), []).append(i)
        self.sizes, shingles, sizes = {}, {}, {}
        for n, members in by_size.items():
            k = min(shingle, n)
            rows = [shingle_hashes(hashes[table.first[i] : table.first[i + 1]], k)[: n - k + 1] for i in members]
            prints = np.concatenate([window_fingerprints(r, np.zeros(1, np.int64), len(r)) for r in rows])
            self.sizes[n] = (k, members, HammingBlocks(prints, radius))
            shingles.setdefault(k, []).extend(rows)
            sizes.setdefault(k, []).extend(np.full(len(r), n) for r in rows)
        self.gates = {}
        for k, rows in shingles.items():
            held = np.unique(np.stack([np.concatenate(rows), np.concatenate(sizes[k]).astype(np.uint64)]), axis=1)
            gate = np.zeros(1 << _GATE_BITS, dtype=bool)
            gate[held[0] >> np.uint64(64 - _GATE_BITS)] = True
            self.gates[k] = (gate, held[0], held[1].astype(np.int64))

    def hits(self, words: Words, hashes: np.ndarray):
        """(shingle size, its hashes, word positions, item sizes) of every shingle shared with an item."""
        last = np.repeat(words.first[1:], np.diff(words.first))
        for k, (gate, held, sizes) in self.gates.items():
            rolled = shingle_hashes(hashes, k)
            at = np.flatnonzero(gate[rolled >> np.uint64(64 - _GATE_BITS)])
            at = at[at + k <= last[at]]
            a, b = np.searchsorted(held, rolled[at], "left"), np.searchsorted(held, rolled[at], "right")
            n = b - a
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
            yield k, rolled, np.repeat(at, n), sizes[place]

    def matches(self, column: pa.Array) -> list[tuple[int, int, float, int, int, int]]:
        """(text, item, similarity, distance, first word, words) of the best window per matching pair."""
        words = split_words(column)
        best: dict[tuple[int, int], tuple] = {}
        for k, rolled, at, sizes in self.hits(words, words.hashes()):
            text_of = np.searchsorted(words.first, at, "right") - 1
            lists: dict[int, list[bytes]] = {}
            pairs = np.unique(np.stack([text_of, sizes]), axis=1).T.tolist() if len(at) else []
            for text, size in pairs:
                first, end = int(words.first[text]), int(words.first[text + 1])
                n = min(size, end - first)
                own = at[(text_of == text) & (sizes == size)]
                marks = np.zeros(end - first - n + 2, dtype=np.int64)
                np.add.at(marks, np.clip(own - first - (n - k), 0, len(marks) - 2), 1)
                np.add.at(marks, np.clip(own - first, 0, len(marks) - 2) + 1, -1)
                starts = np.flatnonzero(np.cumsum(marks)[:-1] > 0)
                shingle, members, index = self.sizes[size]
                prints = window_fingerprints(rolled[first:end], starts, n - k + 1)
                for w, m, distance in index.within(prints):
                    if text not in lists:
                        lists[text] = word_list(words, text)
                    mine = lists[text]
                    start, item = int(starts[w]), members[m]
                    likeness = weighted_jaccard(mine[start : start + n], self.words[item], shingle)
                    found = (-likeness, start, distance, n)
                    if likeness >= self.similarity and found < best.get((text, item), (1,)):
                        best[text, item] = found
        return [(text, item, -b[0], b[2], b[1], b[3]) for (text, item), b in sorted(best.items())]


def item_blocks(benchmark: DataFrame, block_bytes: int, item_id: str, text: str):
    """Lists of (item_id, text) of about `block_bytes` each."""
    items = benchmark.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text")).where("trim(text) <> ''")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-2 * total // block_bytes) if total > block_bytes else 1
    for number in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number) if blocks > 1 else items
        yield [tuple(r) for r in own.orderBy("item_id", "text").collect()]


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
    shingle: int = SHINGLE,
    item_bytes: int = ITEM_BYTES,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per document and benchmark item that it holds."""
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    found = None
    for items in item_blocks(benchmark, item_bytes, item_id, item_text):

        def make(items=items):
            index = ItemIndex(items, radius, similarity, shingle)

            def apply(piece):
                rows = index.matches(piece.column(1))
                columns = list(zip(*rows)) or [[]] * 6
                return pa.RecordBatch.from_arrays(
                    [
                        piece.column(0).take(pa.array(columns[0], pa.int64())),
                        pa.array([index.ids[i] for i in columns[1]], pa.int64()),
                        pa.array(columns[2], pa.float64()),
                        *[pa.array(columns[i], pa.int32()) for i in (3, 4, 5)],
                    ],
                    names=["doc_id", "item_id", "similarity", "distance", "word_start", "word_count"],
                )

            return apply

        part = map_texts(texts, ["doc_id"], "text", SCHEMA, make)
        found = part if found is None else found.unionByName(part)
    return found


def clean_rows(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_bytes: int = ITEM_BYTES, **parameters) -> DataFrame:
    """Rows of `docs` that hold no benchmark item; every column stays as it is."""
    place = docs.columns.index(text)
    settings = {"similarity": SIMILARITY, "radius": RADIUS, "shingle": SHINGLE} | parameters
    for items in item_blocks(benchmark, item_bytes, "item_id", "text"):

        def make(items=items):
            index = ItemIndex(items, settings["radius"], settings["similarity"], settings["shingle"])

            def apply(piece):
                keep = np.ones(piece.num_rows, dtype=bool)
                keep[[m[0] for m in index.matches(piece.column(place))]] = False
                return keep

            return apply

        docs = filter_rows(docs, text, make)
    return docs
