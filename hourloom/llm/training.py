"""Labelled samples of bounded size and models fitted on them in one task, shards of all labelled texts, and the calibration of scores."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm.words import mixed


@dataclass(frozen=True)
class SampleBound:
    """At most `per_class` documents of each class, none over `max_bytes` (None: of any length); so the sample holds 2 * both at most."""

    per_class: int = 1500
    max_bytes: int | None = 32_768


@dataclass(frozen=True)
class Sample:
    """Texts with their class (0/1) and language, ordered by a hash of the id; `share` is class 1's share of all labels."""

    texts: list[str]
    classes: np.ndarray
    langs: list[str | None]
    share: float

    def split(self, every: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Places for fitting and for calibration: every `every`-th document of a class calibrates."""
        rank = np.zeros(len(self.classes), dtype=np.int64)
        for c in (0, 1):
            own = np.flatnonzero(self.classes == c)
            rank[own] = np.arange(len(own))
        held = rank % every == every - 1
        return np.flatnonzero(~held), np.flatnonzero(held)


def fold(doc_id: str, folds: int):
    """crc32 of the id as text, modulo `folds`."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))


def first_by_hash(rows: DataFrame, k: int) -> DataFrame:
    """The `k` rows (all, if fewer) with the least hash of all their columns, whatever ids are null or repeated.

    Only rows under the least bound that leaves `k` of them are sorted, so that no task passes on rows of every other.
    The bounds are halves, quarters and so on of all hashes, counted in one pass.
    """
    order = F.xxhash64(*rows.columns)
    bounds = [-(1 << 63) + (1 << (64 - half)) - 1 for half in range(49)]
    counts = rows.select(order.alias("h")).agg(*[F.count_if(F.col("h") <= F.lit(b)).alias(f"n{i}") for i, b in enumerate(bounds)]).first()
    bound = min((b for b, n in zip(bounds, counts) if n >= k), default=bounds[0])
    return rows.where(order <= F.lit(bound)).orderBy(order, *rows.columns).limit(k)


def fit_in_one_task(rows: DataFrame, fit: Callable[[list[dict]], Any]) -> Any:
    """`fit` over the rows of a bounded sample, run by one executor task; only the model comes to the driver.

    The rows must carry their own order, as they arrive in any.
    """

    def run(batches):
        held = [r for batch in batches for r in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([cloudpickle.dumps(fit(held))], pa.binary())], names=["model"])

    found = rows.repartition(1).mapInArrow(run, "model binary").first()
    return cloudpickle.loads(found["model"]) if found else fit([])


def marked_labels(labels: DataFrame, label: str, doc_id: str = "doc_id") -> DataFrame:
    """(id, class) of the labels 0 and 1 of known ids."""
    marked = labels.select(F.col(doc_id).cast("bigint").alias("id"), F.col(label).cast("int").alias("class"))
    return marked.where("id is not null and class in (0, 1)")


def class_sizes(marked: DataFrame) -> dict[int, int]:
    return {r["class"]: r["count"] for r in marked.groupBy("class").count().collect()}


def share_of(sizes: dict[int, int]) -> float:
    """Class 1's share of all labels; 0 without labels."""
    return sizes.get(1, 0) / max(1, sum(sizes.values()))


def known_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(id, t, l) of the documents that have a text."""
    language = F.col(lang) if lang in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("t"), language.alias("l")).where("t is not null")


def fit_on_labels(
    docs: DataFrame, labels: DataFrame, label: str, bound: SampleBound, fit: Callable[[Sample], Any], doc_id="doc_id", text="text", lang="lang"
) -> Any:
    """The model that `fit` makes of a labelled sample in hash order of the ids.

    The texts of the chosen ids alone leave the documents' scan. Labels other than 0 and 1 and null ids are left out. An
    id repeated among the documents gives its least text.
    """
    marked = marked_labels(labels, label, doc_id)
    share = share_of(class_sizes(marked))
    chosen = None
    for c in (0, 1):
        part = first_by_hash(marked.where(F.col("class") == c).distinct(), bound.per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    source = known_texts(docs, doc_id, text, lang)
    if bound.max_bytes is not None:
        source = source.where(F.octet_length("t") <= bound.max_bytes)
    rows = source.join(F.broadcast(chosen), "id").groupBy("id", "class").agg(F.min("t").alias("t"), F.min("l").alias("l"))

    def fit_rows(held: list[dict]) -> Any:
        held.sort(key=lambda r: (r["order"], r["id"], r["class"]))
        classes = np.array([r["class"] for r in held], dtype=np.int64)
        return fit(Sample([r["t"] for r in held], classes, [r["l"] for r in held], share))

    return fit_in_one_task(rows.withColumn("order", F.xxhash64("id")), fit_rows)


_MARK_BITS = 26


def _marks(ids: np.ndarray) -> list[np.ndarray]:
    """Two places for every id in a table of 2 ** _MARK_BITS bits."""
    return [mixed(ids.astype(np.uint64) + np.uint64(k)) >> np.uint64(64 - _MARK_BITS) for k in (1, 1 << 62)]


def perhaps_marked(source: DataFrame, marked: DataFrame) -> DataFrame:
    """The rows of `source` without most of those whose id is not in `marked`.

    A Bloom filter of 8 MB decides, so that the other texts are not shuffled; it never drops a marked one. Far beyond ten
    million ids it fills up and spares less.
    """

    def fill(batches):
        bits = np.zeros(1 << (_MARK_BITS - 3), dtype=np.uint8)
        for batch in batches:
            for place in _marks(batch.column(0).to_numpy(zero_copy_only=False)):
                np.bitwise_or.at(bits, place >> np.uint64(3), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], names=["bits"])

    bits = np.zeros(1 << (_MARK_BITS - 3), dtype=np.uint8)
    for row in marked.select("id").coalesce(8).mapInArrow(fill, "bits binary").toLocalIterator():
        bits |= np.frombuffer(zlib.decompress(row["bits"]), dtype=np.uint8)
    shared = source.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def perhaps(ids: pd.Series) -> pd.Series:
        places = _marks(ids.to_numpy().astype(np.int64))
        hit = [shared.value[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1 for place in places]
        return pd.Series((hit[0] & hit[1]).astype(bool))

    return source.where("id is not null").where(perhaps("id"))


def labelled_shards(docs: DataFrame, marked: DataFrame, shards: int, least: int = 64, every: int = 4) -> DataFrame:
    """(shard, home, held, order, id, class, t, l): every labelled document, dealt to `shards` partitions by hashes of its id.

    A class with fewer than `least` documents for each shard is dealt several times, so that no shard lacks it; `home` is
    true for one row of a document. About one document of `every` is `held` back from fitting. An id repeated among the
    documents gives its least text.
    """
    chosen = marked.distinct()
    sizes = class_sizes(chosen)
    times = {c: min(shards, -(-least * shards // max(1, sizes.get(c, 0)))) for c in (0, 1)}
    found = perhaps_marked(known_texts(docs), chosen).join(chosen, "id").groupBy("id", "class").agg(F.min("t").alias("t"), F.min("l").alias("l"))
    turn = F.explode(F.sequence(F.lit(0), F.when(F.col("class") == 1, times[1] - 1).otherwise(times[0] - 1))).alias("turn")
    at = F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(shards))
    held = F.pmod(F.xxhash64("id", F.lit("held")), F.lit(every)) == every - 1
    rows = found.select("*", turn).select(
        F.pmod(at + F.col("turn"), F.lit(shards)).cast("int").alias("shard"),
        (F.col("turn") == 0).alias("home"),
        held.alias("held"),
        F.xxhash64("id").alias("order"),
        "id",
        "class",
        "t",
        "l",
    )
    return rows.repartitionById(shards, "shard")


def each_shard(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of every shard in a task, in an order that they carry themselves."""
    own: dict[int, list[dict]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            own.setdefault(row["shard"], []).append(row)
    for shard in sorted(own):
        yield shard, sorted(own.pop(shard), key=lambda r: (r["order"], r["id"], r["class"]))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def class_weights(classes: np.ndarray, share: float) -> np.ndarray:
    """Weight of every document, 1 on average, that gives class 1 its true share; both classes must be there."""
    n1 = classes.sum()
    return np.where(classes == 1, share / n1, (1 - share) / (len(classes) - n1)) * len(classes)


def calibrate(raw: np.ndarray, classes: np.ndarray, share: float, ridge: float = 1e-2, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve over `raw`, the classes weighted to class 1's true share."""
    n1 = classes.sum()
    n0 = len(classes) - n1
    if not n0 or not n1:
        return 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    weight = class_weights(classes, share)
    target = np.where(classes == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    mean, scale = raw.mean(), raw.std() or 1.0
    x = np.stack([(raw - mean) / scale, np.ones(len(raw))], axis=1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = sigmoid(x @ w)
        gradient = x.T @ (weight * (p - target)) + ridge * np.array([w[0], 0.0])
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([ridge, 1e-6])
        step = np.linalg.solve(curve, gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1] - w[0] * mean / scale)
