"""K-means with all restarts, and all numbers of clusters, in one pass per step.

The centres of every run still moving go to the tasks together; a task labels its rows for all runs with one matrix product,
adds them up by centre with another and returns one partial sum, so a step is one small job however many runs there are. A
run whose centres rest takes no further part. The points are packed once into matrices, which every step reads as they are.

Points lie on a grid of 2 ** -20 and sums are whole numbers, so neither the partitions nor their order change a centre.
Distances are compared on a grid as well: a point between two centres goes to the first. Starts are drawn by squared
distance (k-means++) from the `start_rows` different points with the least hashes, each with its number of copies, and
first come to rest on these, a task per run, so that few steps over the whole table remain. The bound holds for starts
only: from there every step uses all points until the centres rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.config import KMeansConfig

GRID = float(1 << 20)
ROWS_AT_ONCE = 4096  # whole sums of so many grid points are exact in doubles up to 2 ** 21 deviations
ROWS_IN_CACHE = 512  # points whose distances to all centres are held at once
SUMS_AT_ONCE = 32  # partial sums that the driver adds itself


@dataclass
class Run:
    """One fit: `centers` (k, d) and, once closed, its cost and each cluster's number of points, summed squared norms and mean."""

    k: int
    restart: int
    centers: np.ndarray
    moving: bool = True
    cost: float = 0.0
    counts: np.ndarray | None = None
    squares: np.ndarray | None = None
    means: np.ndarray | None = None


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The `point` arrays as matrices of a bounded number of rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            piece = batch.column(0).slice(start, ROWS_AT_ONCE)
            flat = piece.flatten().to_numpy(zero_copy_only=False)
            yield flat.reshape(len(piece), -1)


def distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """(point, centre): squared distances on the grid."""
    d = (points**2).sum(axis=1)[:, None] - 2 * points @ centers.T + (centers**2).sum(axis=1)
    return np.maximum(np.rint(d * GRID), 0) / GRID


def starts_of(runs: list[Run]) -> list[int]:
    return np.cumsum([0, *(r.k for r in runs)]).tolist()


def nearest(points: np.ndarray, centers: np.ndarray, starts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(point, run): place of the nearest centre among all centres, and its squared distance."""
    d = distances(points, centers)
    labels = np.stack([d[:, a:b].argmin(axis=1) + a for a, b in zip(starts, starts[1:])], axis=1)
    return labels, np.take_along_axis(d, labels, axis=1)


def packed(points: DataFrame) -> RDD:
    """The points as matrices of a bounded number of rows, in whole steps of the grid: four bytes each where they fit."""

    def pack(batches):
        for x in blocks(batches):
            whole = x * GRID
            narrow = bool((np.rint(whole) == whole).all() and (np.abs(whole) < 1 << 31).all())
            held = whole.astype(np.int32) if narrow else whole
            yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary()), pa.array([len(x)]), pa.array([narrow])], names=["held", "n", "narrow"])

    rows = points.mapInArrow(pack, "held binary, n bigint, narrow boolean").rdd
    return rows.map(lambda r: np.frombuffer(r["held"], np.int32 if r["narrow"] else np.float64).reshape(r["n"], -1))


def members(points: np.ndarray, centers: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(centre, point): 1 at the nearest centre of every run, the first at a tie; (run, point): its squared distance.

    `points` has their coordinates, a 1 and their squared norm; `sizes` has the number of centres of each run.
    """
    terms = np.column_stack([centers * (-2 * GRID), (centers**2).sum(axis=1) * GRID, np.full(len(centers), GRID)])
    d = terms @ points.T
    np.maximum(np.rint(d, out=d), 0, out=d)
    member, least, at, run = np.empty_like(d), np.empty((len(sizes), len(points))), 0, 0
    for k, same in groupby(sizes):
        n = len(list(same))
        apart, own = (m[at : at + n * k].reshape(n, k, -1) for m in (d, member))
        best, place = apart[:, 0].copy(), np.zeros((n, len(points)), dtype=np.int16)
        for c in range(1, k):
            np.copyto(place, c, where=apart[:, c] < best)
            np.minimum(best, apart[:, c], out=best)
        for c in range(k):
            np.equal(place, c, out=own[:, c])
        least[run : run + n] = best / GRID
        at, run = at + n * k, run + n
    return member, least


def _added(parts: RDD) -> list[np.ndarray]:
    """The sums over all partitions; of more than `SUMS_AT_ONCE`, tasks add them up to so many first."""

    def plus(a, b):
        return [x + y for x, y in zip(a, b)]

    if parts.getNumPartitions() > SUMS_AT_ONCE:
        parts = parts.mapPartitionsWithIndex(lambda i, own: ((i % SUMS_AT_ONCE, x) for x in own)).reduceByKey(plus, SUMS_AT_ONCE).values()
    return reduce(plus, parts.collect())


def _sums(held: RDD, runs: list[Run]) -> list[np.ndarray]:
    """By centre: points, whole sums of their coordinates, sum of squared norms; by run: sum of squared distances."""
    centers, sizes = np.concatenate([r.centers for r in runs]), [r.k for r in runs]
    total, width = centers.shape

    def partial(pieces):
        counts, sums = np.zeros(total, dtype=np.int64), np.zeros((total, width), dtype=np.int64)
        squares, costs = np.zeros(total), np.zeros(len(sizes))
        for piece in pieces:
            x = piece / GRID
            x = np.column_stack([x, np.ones(len(x)), (x**2).sum(axis=1)])
            for start in range(0, len(x), ROWS_IN_CACHE):
                some = x[start : start + ROWS_IN_CACHE]
                member, least = members(some, centers, sizes)
                added = member @ some
                counts += added[:, width].astype(np.int64)
                sums += (added[:, :width] * GRID).astype(np.int64)
                squares += added[:, width + 1]
                costs += least.sum(axis=1)
        yield [counts, sums, squares, costs]

    return _added(held.mapPartitions(partial))


def _step(held: RDD, runs: list[Run], tol: float) -> None:
    """Moves the centres of `runs` to their points' means; a centre without points stays."""
    counts, sums, *_ = _sums(held, runs)
    for run, a, b in zip(runs, starts_of(runs), starts_of(runs)[1:]):
        n = counts[a:b, None]
        moved = np.where(n > 0, sums[a:b] / np.maximum(n, 1) / GRID, run.centers)
        run.moving = bool((((moved - run.centers) ** 2).sum(axis=1) > tol**2).any())
        run.centers = moved


def _close(held: RDD, runs: list[Run]) -> None:
    """Costs and sizes by the final centres."""
    counts, sums, squares, costs = _sums(held, runs)
    for run, a, b, cost in zip(runs, starts_of(runs), starts_of(runs)[1:], costs):
        n = counts[a:b, None]
        run.counts, run.squares = counts[a:b].astype(np.float64), squares[a:b]
        run.means = np.where(n > 0, sums[a:b] / np.maximum(n, 1) / GRID, run.centers)
        run.cost = float(f"{cost:.10g}")


def start_points(points: DataFrame, rows: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The different points with the least hashes, in hash order, and how often each occurs."""
    ranked = points.groupBy("point").count().orderBy(F.xxhash64("point", F.lit(seed)), "point").limit(rows).collect()
    return np.array([r["point"] for r in ranked]), np.array([r["count"] for r in ranked], dtype=np.float64)


def draw_start(sample: np.ndarray, k: int, restart: int, seed: int) -> np.ndarray:
    """k-means++: each further centre is drawn by the squared distance to those before; no point twice."""
    rng = np.random.default_rng([seed, k, restart])
    chosen = [int(rng.integers(len(sample)))]
    least = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        up_to = np.cumsum(least)
        chosen.append(int(np.searchsorted(up_to, rng.random() * up_to[-1], side="right")))
        least = np.minimum(least, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def rested(sample: np.ndarray, weights: np.ndarray, centers: np.ndarray, config: KMeansConfig) -> np.ndarray:
    """The centres after steps over a weighted sample only, until they rest."""
    for _ in range(config.max_iter):
        member = np.zeros((len(sample), len(centers)))
        member[np.arange(len(sample)), distances(sample, centers).argmin(axis=1)] = weights
        held = member.sum(axis=0)
        moved = np.where(held[:, None] > 0, member.T @ sample / np.maximum(held, 1)[:, None], centers)
        still = (((moved - centers) ** 2).sum(axis=1) <= config.tol**2).all()
        centers = moved
        if still:
            break
    return centers


def first_centers(points: DataFrame, sample: np.ndarray, weights: np.ndarray, wanted: list[tuple[int, int]], config: KMeansConfig) -> list[np.ndarray]:
    """Starts for every (k, restart), a task for each."""
    spark = points.sparkSession

    def run(batches):
        for batch in batches:
            made = [
                rested(sample, weights, draw_start(sample, k, restart, config.seed), config).tolist()
                for k, restart in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.list_(pa.float64())))], names=["id", "centers"])

    asked = spark.createDataFrame([(i, *w) for i, w in enumerate(wanted)], "id int, k int, restart int").repartitionByRange(len(wanted), "id")
    rows = asked.mapInArrow(run, "id int, centers array<array<double>>").collect()
    return [np.array(c) for _, c in sorted((r["id"], r["centers"]) for r in rows)]


def fit_runs(points: DataFrame, sizes: list[int], config: KMeansConfig) -> dict[int, Run]:
    """The cheapest of `config.restarts` runs for each number of clusters in `sizes`, at most one per different point.

    `points` holds one array column `point` on the grid, kept by the caller for its few reads; steps read it packed.
    A tie goes to the earlier restart. An empty table has no fit and raises a ValueError.
    """
    sample, weights = start_points(points, config.start_rows, config.seed)
    if not len(sample):
        raise ValueError("no profile to cluster")
    wanted = [(min(k, len(sample)), restart) for k in sizes for restart in range(config.restarts)]
    runs = [Run(*w, c) for w, c in zip(wanted, first_centers(points, sample, weights, wanted, config))]
    held = packed(points).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for _ in range(config.max_iter):
            moving = [r for r in runs if r.moving]
            if not moving:
                break
            _step(held, moving, config.tol)
        _close(held, runs)
    finally:
        held.unpersist()
    per_size = [runs[i : i + config.restarts] for i in range(0, len(runs), config.restarts)]
    return {k: min(tried, key=lambda r: (r.cost, r.restart)) for k, tried in zip(sizes, per_size)}


def silhouettes(points: DataFrame, runs: list[Run]) -> list[float]:
    """Mean silhouette by squared Euclidean distance of every run, all in one pass; 0 with fewer than two clusters.

    Mean distances to a cluster follow from its size, mean and squared norms, so no pair is formed. A point alone in
    its cluster counts as 0.
    """
    centers, starts = np.concatenate([r.centers for r in runs]), starts_of(runs)
    means, n, squares = (np.concatenate([getattr(r, c) for r in runs]) for c in ("means", "counts", "squares"))
    spread = np.divide(squares, n, out=np.zeros_like(n), where=n > 0)

    def partial(batches):
        total, rows = np.zeros(len(starts) - 1), 0
        for x in blocks(batches):
            labels, _ = nearest(x, centers, starts)
            apart = (x**2).sum(axis=1)[:, None] + spread - 2 * x @ means.T
            apart = np.where(n > 0, np.maximum(apart, 0), np.inf)
            size = n[labels]
            own = np.take_along_axis(apart, labels, axis=1) * size / np.maximum(size - 1, 1)
            np.put_along_axis(apart, labels, np.inf, axis=1)
            other = np.stack([apart[:, a:b].min(axis=1) for a, b in zip(starts, starts[1:])], axis=1)
            widest = np.maximum(own, other)
            known = np.isfinite(other) & (size > 1) & (widest > 0)
            total += np.where(known, (np.where(known, other, 0) - own) / np.where(known, widest, 1), 0).sum(axis=0)
            rows += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["rows", "total"])

    made = points.mapInArrow(partial, "rows bigint, total array<double>")
    sums = made.agg(F.sum("rows"), *[F.sum(F.col("total")[i]) for i in range(len(runs))]).first()
    return [float(f"{s / sums[0]:.10g}") if sums[0] else 0.0 for s in sums[1:]]
