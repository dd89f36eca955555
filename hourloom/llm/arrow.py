"""Arrow batches inside tasks: bounded slices of text, passing whole rows through, and giving memory back after a task."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SLICE_BYTES = 1 << 21


def bounded(batches: Iterable[pa.RecordBatch], column: str | int, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices whose texts hold about `max_bytes` together; a longer single text makes a slice of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(lengths.astype(np.int64)) // max_bytes)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            yield batch.slice(a, b - a)


def texts(batch: pa.RecordBatch, column: str | int) -> list[str]:
    """Whole texts; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def utf8(batch: pa.RecordBatch, column: str | int) -> list[bytes]:
    """UTF-8 of the whole texts; null counts as empty."""
    return [t or b"" for t in batch.column(column).cast(pa.large_binary()).to_pylist()]


def worker_memory() -> dict:
    """What outlives a task in its worker process. Task functions bring their own copies of modules, so it has a module of its own."""
    return sys.modules.setdefault("hourloom_worker", types.ModuleType("hourloom_worker")).__dict__


def give_back() -> None:
    """Freed memory of this process goes back to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)


def lean(run: Callable, keeps: str = "") -> Callable:
    """`run` for a worker that serves many stages in turn: what other operators left there is dropped before a task, unless
    its key begins with `keeps`, and freed memory goes back to the system after it instead of adding up from stage to stage."""

    def task(batches):
        held = worker_memory()
        for key in [k for k in held if k.startswith("held ") and not (keeps and k.startswith(keeps))]:
            del held[key]
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def map_texts(
    df: DataFrame,
    keep: list[str],
    text: str,
    schema: str | T.StructType,
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
    keeps: str = "",
) -> DataFrame:
    """`make()` runs once per task and returns a function over bounded slices of `keep` + `text` (the last column)."""

    def run(batches):
        apply = make()
        for piece in bounded(batches, len(keep)):
            yield apply(piece)

    return df.select(*[df[c] for c in keep], df[text]).mapInArrow(lean(run, keeps), schema)


def filter_rows(df: DataFrame, text: str, make: Callable[[], Callable[[pa.RecordBatch], np.ndarray]]) -> DataFrame:
    """Rows for which `make()`'s function over slices says true; every column passes through untouched."""
    place = df.columns.index(text)

    def run(batches):
        apply = make()
        for piece in bounded(batches, place):
            yield piece.filter(pa.array(apply(piece)))

    return df.mapInArrow(lean(run), df.schema)
