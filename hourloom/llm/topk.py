"""Exact top-k by integer inner product: columnar branch and bound over blocks of dimensions.

Components become floor(1024 x). A slice of candidates is laid out by dimension; a block of queries meets it one block of
dimensions after the other. After each block a candidate's score lies within its partial sum plus or minus the product of
the remaining norms (Cauchy-Schwarz), so candidates that cannot reach the k-th best so far are dropped and the rest are
compacted for the next block. What is left is exact.

Queries are sent in blocks of bounded bytes, one pass over the candidates each; candidates are never joined or shuffled.
Every task returns k rows per query, which are reduced in two steps, first within groups of tasks.

Defined cases: vectors that are null, empty or hold a null or non-finite component, and rows without an id, take no part;
a query meets the vectors of its own length; equal scores go to the smaller id; repeated rows are candidates each, but a
query repeated with the same vector is asked once, and its own id is never among its answers; sums that doubles cannot
hold are taken in whole numbers, and a score beyond 64 bits is ranked as it is and shown as the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourloom.session import materialize

SCALE = 1024
BLOCK_BYTES = 16 << 20
DIMENSIONS = 16
SLICE = 8192
_EXACT = float(1 << 53)


def scaled(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per vector length: places in the column, and vectors of floor(1024 x) as doubles."""
    lists = column.cast(pa.large_list(pa.float64()))
    offsets = np.asarray(lists.offsets)
    starts, lengths = offsets[:-1], np.diff(offsets)
    values = np.floor(SCALE * lists.values.to_numpy(zero_copy_only=False))
    there = lists.is_valid().to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(lengths[there & (lengths > 0)]).tolist():
        places = np.flatnonzero(there & (lengths == n))
        vectors = values[starts[places][:, None] + np.arange(n)]
        good = np.isfinite(vectors).all(axis=1)
        out[n] = (places[good], vectors[good])
    return out


class BestOf:
    """The k best (score, id) of every query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = [np.zeros(0) for _ in range(queries)]
        self.ids = [np.zeros(0, np.int64) for _ in range(queries)]

    def floor(self, q: int) -> float:
        return self.scores[q][-1] if len(self.scores[q]) == self.k else -np.inf

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        keep = np.lexsort((ids, -scores))[: self.k]
        self.scores[q], self.ids[q] = scores[keep], ids[keep]


def _exact_dot(query: np.ndarray, columns: np.ndarray) -> np.ndarray:
    return np.array([sum(int(a) * int(b) for a, b in zip(query, c)) for c in columns.T], dtype=object)


def search_slice(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, best: BestOf, at: np.ndarray) -> None:
    """Bring the candidates of one slice into `best`; row i of `queries` is entry at[i] there."""
    dims = vectors.shape[1]
    if not len(vectors) or not len(queries):
        return
    if dims * np.abs(vectors).max() * np.abs(queries).max() >= _EXACT:
        for i, query in enumerate(queries):
            own = ids != query_ids[i]
            best.add(at[i], _exact_dot(query, vectors.T[:, own]), ids[own])
        return
    columns = np.ascontiguousarray(vectors.T)
    edges = list(range(0, dims, DIMENSIONS)) + [dims]
    mass = np.array([np.sqrt((columns[e:] ** 2).sum(axis=0)) for e in edges])
    query_mass = np.array([np.sqrt((queries[:, e:] ** 2).sum(axis=1)) for e in edges])
    first = queries[:, : edges[1]] @ columns[: edges[1]]
    for i, query in enumerate(queries):
        alive = np.flatnonzero(ids != query_ids[i])
        partial = first[i, alive]
        for block in range(1, len(edges)):
            slack = query_mass[block, i] * mass[block, alive] * (1 + 1e-9)
            floor = best.floor(at[i])
            if len(alive) > best.k and block + 1 < len(edges):
                low = partial - slack
                floor = max(floor, np.partition(low, len(low) - best.k)[len(low) - best.k])
            keep = partial + slack >= floor
            alive, partial = alive[keep], partial[keep]
            if block + 1 < len(edges) and len(alive):
                low, high = edges[block], edges[block + 1]
                partial = partial + query[low:high] @ columns[low:high].take(alive, axis=1)
        if len(alive):
            best.add(at[i], partial, ids[alive])


def _search(batches: Iterable[pa.RecordBatch], block: list[tuple[int, int, list[int]]], k: int) -> Iterator[pa.RecordBatch]:
    numbers = np.array([b[0] for b in block], dtype=np.int64)
    query_ids = np.array([b[1] for b in block], dtype=np.int64)
    sizes = np.array([len(b[2]) for b in block])
    by_size = {n: (np.flatnonzero(sizes == n), np.array([b[2] for b in block if len(b[2]) == n], dtype=np.float64)) for n in set(sizes.tolist())}
    best = BestOf(len(block), k)
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            piece = batch.slice(at, SLICE)
            ids = piece.column(0).to_numpy(zero_copy_only=False)
            for n, (places, vectors) in scaled(piece.column(1)).items():
                if n in by_size:
                    rows, queries = by_size[n]
                    search_slice(query_ids[rows], queries, ids[places].astype(np.int64), vectors, best, rows)
    counts = [len(s) for s in best.scores]
    if sum(counts):
        limit = (1 << 63) - 1
        scores = [max(-limit, min(limit, int(x))) for s in best.scores for x in s]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(numbers, counts)), pa.array(np.repeat(query_ids, counts)), pa.array(np.concatenate(best.ids)), pa.array(scores, pa.int64())],
            names=["number", "query_id", "vec_id", "score"],
        )


def query_blocks(queries: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, int, list[int]]]]:
    """Lists of (number, id, components), each of at most about `block_bytes`."""
    n, width = queries.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not n:
        return
    rows = max(1, block_bytes // (8 * width))
    blocks = -(-n // rows)
    dealt = queries.repartition(blocks).withColumn("block", F.spark_partition_id())
    held = materialize(dealt, "queries")
    number = 0
    for block in range(blocks):
        out = []
        for r in held.where(F.col("block") == block).orderBy("id", "vector").collect():
            out.append((number, r["id"], r["vector"]))
            number += 1
        if out:
            yield out


def top_k(vectors: DataFrame, is_query, k: int = 10, block_bytes: int = BLOCK_BYTES, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every row for which the condition `is_query` holds."""
    named = vectors.where(F.col(vec_id).isNotNull())
    source = named.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).alias("v"))
    usable = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    asked = named.where(is_query).select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).alias("v")).where(usable)
    asked = asked.select("id", F.transform("v", lambda x: F.floor(x.cast("double") * SCALE)).alias("vector")).distinct()
    found = None
    for block in query_blocks(asked, block_bytes):
        part = source.mapInArrow(lambda batches, block=block: _search(batches, block, k), "number bigint, query_id bigint, vec_id bigint, score bigint")
        part = part.withColumn("part", F.spark_partition_id() % 64)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    order = (F.desc("score"), F.asc("vec_id"))
    near = found.withColumn("r", F.row_number().over(Window.partitionBy("number", "part").orderBy(*order))).where(F.col("r") <= k)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
