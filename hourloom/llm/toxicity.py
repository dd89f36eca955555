"""Toxicity: a convolutional classifier over hashed word embeddings, fitted in NumPy on all labelled documents.

A word's vector is the sum of the hashed embeddings of the word, of its first four and of its first five bytes, so that
inflected forms of a learned stem are recognised. Filters of widths 1, 2 and 3 slide over all words of a text, the
largest answer of each filter enters a logistic layer, and the score is calibrated on labelled documents that were not
fitted, a quarter of all. Those documents, weighted to the classes' true shares, also give a threshold per language; other languages take
the pooled one. The language only chooses the threshold, never the score.

Labelled documents of any length and number take part. Up to `shard` of a class they are fitted in one task. More are dealt
by hashes into shards of about that size, which are fitted side by side from the same net; after each of `rounds` rounds
the nets are mixed: a weight becomes its mean over the shards that moved it, summed in whole steps of a grid, so that no
order of the tasks shows. Every document to be fitted is in a batch at least once.

Defined cases: null and empty texts score like a text without known words; without labels of both classes every score is
the share of class 1 (0 without labels); repeated rows are scored each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm.arrow import bounded, filter_rows, give_back, lean, map_texts
from hourloom.llm.training import (
    Sample,
    SampleBound,
    calibrate,
    class_sizes,
    class_weights,
    each_shard,
    fit_in_one_task,
    fit_on_labels,
    labelled_shards,
    marked_labels,
    share_of,
    sigmoid,
)
from hourloom.llm.words import mixed, split_words

WIDTHS = (1, 2, 3)
THRESHOLD = 0.3
_PREFIXES = (None, 4, 5)
_MIX_GRID = float(1 << 24)


@dataclass(frozen=True)
class NetConfig:
    bucket_bits: int = 20
    min_documents: int = 3
    size: int = 8
    filters: int = 6
    steps: int = 700
    batch: int = 32
    rate: float = 0.1
    forget: float = 0.25
    seed: int = 7
    min_language: int = 20
    shard: int = 3000
    rounds: int = 4


def buckets(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets (words x features) of all words, and the first word of each text."""
    words = split_words(column)
    sums = words.prefix_sums()
    out = np.empty((len(words.start), len(_PREFIXES)), dtype=np.int64)
    for k, longest in enumerate(_PREFIXES):
        out[:, k] = mixed(words.hashes(sums, longest) + np.uint64(k)) >> np.uint64(64 - bits)
    return out, words.first


def _slices(texts: list[str], chunk: int = 64) -> Iterator[pa.Array]:
    """A few texts at a time, of bounded bytes together."""
    for i in range(0, len(texts), chunk):
        batch = pa.RecordBatch.from_arrays([pa.array(texts[i : i + chunk], pa.large_string())], names=["text"])
        yield from (piece.column(0) for piece in bounded([batch], 0))


def buckets_of(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for a list of texts, a few at a time."""
    parts = [buckets(piece, bits) for piece in _slices(texts)]
    counts = np.concatenate([np.diff(first) for _, first in parts])
    return np.concatenate([hashed for hashed, _ in parts]), np.concatenate([[0], np.cumsum(counts)])


def documents_by_bucket(texts: list[str], classes: np.ndarray, bits: int) -> np.ndarray:
    """(bucket, feature, class): how many documents have it."""
    out = np.zeros((1 << bits, len(_PREFIXES), 2), dtype=np.int32)
    if texts:
        hashed, first = buckets_of(texts, bits)
        doc = np.repeat(np.arange(len(texts)), np.diff(first))
        for k in range(hashed.shape[1]):
            pairs = np.unique(hashed[:, k] * len(texts) + doc)
            for c in (0, 1):
                out[:, k, c] = np.bincount(pairs[classes[pairs % len(texts)] == c] // len(texts), minlength=1 << bits)
    return out


def _padded(rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with an empty margin after each text; where each text begins, and how many windows it has."""
    margin = max(WIDTHS) - 1
    counts = np.diff(first)
    begin = first[:-1] + margin * np.arange(len(counts))
    out = np.zeros((len(rows) + margin * (len(counts) + 1), rows.shape[1]), dtype=rows.dtype)
    out[np.arange(len(rows)) + margin * np.repeat(np.arange(len(counts)), counts)] = rows
    return out, begin, counts + margin


def _groups(first: np.ndarray, words: int = 32_768) -> list[tuple[int, int]]:
    """Neighbouring texts of about `words` words together; a longer text is alone. Bounds what the filters hold at once."""
    cuts = np.flatnonzero(np.diff(first[1:] // words)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(first) - 1]))


class TextNet:
    """Embeddings of the known buckets (row 0: unknown), filters and output layer."""

    def __init__(self, known: np.ndarray, config: NetConfig):
        rng = np.random.default_rng(config.seed)
        self.config = config
        self.known = known
        self.embed = rng.normal(0, 0.1, (len(known) + 1, config.size)).astype(np.float32)
        self.embed[0] = 0
        self.filters = [rng.normal(0, 0.3, (w, config.size, config.filters)).astype(np.float32) for w in WIDTHS]
        self.offsets = np.zeros(len(WIDTHS) * config.filters, dtype=np.float32)
        self.out = rng.normal(0, 0.3, len(self.offsets)).astype(np.float32)
        self.base = np.float32(0)
        self.past = [np.full_like(p, 1e-3) for p in (self.embed, *self.filters, self.offsets, self.out)]
        self.past_base = 1e-3
        self._table = None

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    def places(self, hashed: np.ndarray) -> np.ndarray:
        if self._table is None:
            self._table = np.zeros(1 << self.config.bucket_bits, dtype=np.int32)
            self._table[self.known] = np.arange(1, len(self.known) + 1)
        return self._table[hashed]

    def vectors(self, places: np.ndarray) -> np.ndarray:
        return sum(self.embed.take(places[:, k], axis=0) for k in range(places.shape[1]))

    def answers(self, x: np.ndarray) -> np.ndarray:
        """Every filter (rows) at every word (columns)."""
        n = len(x) - max(WIDTHS) + 1
        flat = np.concatenate([f[k] for f in self.filters for k in range(len(f))], axis=1)
        y = flat.T @ x.T
        step, at, parts = self.config.filters, 0, []
        for width in WIDTHS:
            z = y[at : at + step, :n].copy()
            for k in range(1, width):
                z += y[at + k * step : at + (k + 1) * step, k : k + n]
            at += width * step
            parts.append(z)
        return np.concatenate(parts)

    def logits(self, column: pa.Array) -> np.ndarray:
        if not len(column):
            return np.zeros(0)
        hashed, first = buckets(column, self.config.bucket_bits)
        pooled = []
        for a, b in _groups(first):
            places, begin, _ = _padded(self.places(hashed[first[a] : first[b]]), first[a : b + 1] - first[a])
            pooled.append(np.maximum.reduceat(self.answers(self.vectors(places)), begin, axis=1).T + self.offsets)
        return np.maximum(np.concatenate(pooled), 0).astype(np.float64) @ self.out + float(self.base)

    def start_from(self, seen: np.ndarray, documents: list[int]) -> None:
        """The first dimension starts as how surely a bucket's documents lean to class 1, and one narrow filter reads it.

        `seen` holds (known bucket, feature, class) counts of documents, `documents` their number by class.
        """
        places = self.places(self.known)
        for k in range(seen.shape[1]):
            own = seen[:, k].sum(axis=1) > 0
            n0, n1 = (seen[own, k, c] + 0.5 for c in (0, 1))
            lean_to = np.log(n1 / (documents[1] + 1.0)) - np.log(n0 / (documents[0] + 1.0))
            self.embed[places[own], 0] = lean_to / np.sqrt(1 / n0 + 1 / n1) / 3.0
        self.filters[0][0, :, 0] = 0
        self.filters[0][0, 0, 0] = 1.0
        self.out[0] = 1.0

    def batches(self, classes: np.ndarray, steps: int, rng: np.random.Generator, due: np.ndarray) -> Iterator[np.ndarray]:
        """`steps` random batches, half of each class, and more for the documents `due` that none of them held."""
        by_class = [own for own in (np.flatnonzero(classes == k) for k in (0, 1)) if len(own)]
        half, waiting = self.config.batch // 2, np.zeros(len(classes), dtype=bool)
        waiting[due] = True
        for _ in range(steps):
            own = np.concatenate([rng.choice(k, half) for k in by_class])
            waiting[own] = False
            yield own
        left = [k[waiting[k]] for k in by_class]
        for i in range(0, max(map(len, left), default=0), half):
            parts = [some[i : i + half] for some in left]
            yield np.concatenate([np.concatenate([part, rng.choice(k, half - len(part))]) for part, k in zip(parts, by_class)])

    def fit(self, texts: list[str], classes: np.ndarray, steps: int, rng: np.random.Generator, due: np.ndarray) -> None:
        """Adagrad over small batches; a word loses each of its features at times, so that stems are learned too."""
        c = self.config
        hashed, first = buckets_of(texts, c.bucket_bits)
        rows, past = self.places(hashed), self.past
        del hashed
        for own in self.batches(classes, steps, rng, due):
            counts = first[own + 1] - first[own]
            taken = np.concatenate([rows[first[i] : first[i + 1]] for i in own])
            taken = taken * (rng.random(taken.shape, dtype=np.float32) >= c.forget)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            pooled, near = [], []
            for a, b in _groups(bounds):
                places, begin, windows = _padded(taken[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                x = self.vectors(places)
                z = self.answers(x)
                best = np.stack([z[:, low : low + n].argmax(axis=1) + low for low, n in zip(begin, windows)])
                pooled.append(z[np.arange(len(z)), best])
                near.append([(x[best + k], places[best + k]) for k in range(max(WIDTHS))])
            pooled = np.concatenate(pooled) + self.offsets
            near = [tuple(np.concatenate(part) for part in zip(*(own_near[k] for own_near in near))) for k in range(max(WIDTHS))]
            live = np.maximum(pooled, 0)
            error = (sigmoid(live @ self.out + self.base) - classes[own]).astype(np.float32) / len(own)
            back = error[:, None] * self.out * (pooled > 0)
            grads = [np.zeros_like(f) for f in self.filters]
            moved_rows, moved_values = [], []
            for w, f in enumerate(self.filters):
                own_filters = slice(w * c.filters, (w + 1) * c.filters)
                g = back[:, own_filters]
                for k in range(WIDTHS[w]):
                    vectors, at_word = (part[:, own_filters] for part in near[k])
                    grads[w][k] = np.einsum("df,dfe->ef", g, vectors)
                    moved_rows.append(at_word.reshape(-1, at_word.shape[-1]))
                    moved_values.append((g[:, :, None] * f[k].T[None]).reshape(-1, c.size))
            where, what = np.concatenate(moved_rows), np.concatenate(moved_values)
            touched, inverse = np.unique(where, return_inverse=True)
            step = np.zeros((len(touched), c.size), dtype=np.float32)
            inverse = inverse.reshape(where.shape)
            for k in range(where.shape[1]):
                np.add.at(step, inverse[:, k], what)
            past[0][touched] += step**2
            self.embed[touched] -= c.rate * step / np.sqrt(past[0][touched])
            self.embed[0] = 0
            for p, value, g in zip(past[1:], (*self.filters, self.offsets, self.out), (*grads, back.sum(axis=0), live.T @ error)):
                p += g**2
                value -= c.rate * g / np.sqrt(p)
            self.past_base += float(error.sum()) ** 2
            self.base = np.float32(self.base - c.rate * error.sum() / np.sqrt(self.past_base))

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """All weights and their past squares as rows of one width: a row per embedding, then the rest."""
        pairs = [(self.embed, *self.filters, self.offsets, self.out, self.base), (*self.past, self.past_base)]
        size, out = self.config.size, []
        for first, *rest in pairs:
            flat = np.concatenate([np.ravel(p) for p in rest])
            out.append(np.concatenate([first, np.pad(flat, (0, -len(flat) % size)).reshape(-1, size)], dtype=np.float32))
        return out[0], out[1]

    def set_weights(self, values: np.ndarray, past: np.ndarray) -> None:
        n = len(self.embed)
        for whole, parts in ((values, (self.embed, *self.filters, self.offsets, self.out)), (past, self.past)):
            parts[0][:] = whole[:n]
            flat, at = whole[n:].ravel(), 0
            for part in parts[1:]:
                part[:] = flat[at : at + part.size].reshape(part.shape)
                at += part.size
        self.base, self.past_base = np.float32(values[n:].ravel()[at]), float(past[n:].ravel()[at])

    def lighter(self) -> TextNet:
        """Without what only fitting needs."""
        self.past = None
        return self


@dataclass
class ToxicityModel:
    net: TextNet | None
    slope: float
    offset: float
    pooled: float
    by_language: dict[str, float]

    def scores(self, column: pa.Array) -> np.ndarray:
        raw = self.net.logits(column) if self.net else np.zeros(len(column))
        return sigmoid(self.slope * raw + self.offset) if self.net else np.full(len(column), self.offset)

    def thresholds(self, langs: list[str | None]) -> np.ndarray:
        return np.array([self.by_language.get(x, self.pooled) for x in langs], dtype=np.float64)


def best_threshold(scores: np.ndarray, classes: np.ndarray, weights: np.ndarray, default: float) -> float:
    """Threshold with the best F1 over weighted documents; among equals the one nearest to `default`."""
    levels = np.unique(scores)
    options = np.unique(np.concatenate([[default], (levels[1:] + levels[:-1]) / 2]))
    order = np.argsort(scores, kind="stable")
    found = np.searchsorted(scores[order], options, side="left")
    above, true = (np.concatenate([np.cumsum(w[order][::-1])[::-1], [0.0]])[found] for w in (weights, weights * (classes == 1)))
    f1 = np.round(2 * true / (above + weights[classes == 1].sum()), 9)
    best = options[f1 == f1.max()]
    return float(best[np.argmin(np.abs(best - default))])


def first_net(by_bucket: np.ndarray, known: np.ndarray, documents: list[int], config: NetConfig) -> TextNet:
    net = TextNet(known, config)
    net.start_from(by_bucket, documents)
    return net


def calibrated(
    raw: np.ndarray, classes: np.ndarray, langs: np.ndarray, share: float, default: float, config: NetConfig, net: TextNet | None = None
) -> ToxicityModel:
    """The model with its curve and thresholds, from the answers of its net to documents of both classes."""
    slope, offset = calibrate(raw, classes, share)
    scores = sigmoid(slope * raw + offset)
    weights = class_weights(classes, share)
    by_language = {}
    for lang in np.unique(langs[langs != ""]):
        own = langs == lang
        if min((classes[own] == 1).sum(), (classes[own] == 0).sum()) >= config.min_language:
            by_language[str(lang)] = best_threshold(scores[own], classes[own], weights[own], default)
    return ToxicityModel(net, slope, offset, best_threshold(scores, classes, weights, default), by_language)


def fit_model(sample: Sample, config: NetConfig = NetConfig(), default: float = THRESHOLD) -> ToxicityModel:
    """The model of a sample that one task can hold."""
    if len(np.unique(sample.classes)) < 2:
        return ToxicityModel(None, 0.0, sample.share, default, {})
    fitting, held = sample.split()
    if len(np.unique(sample.classes[held])) < 2:
        held = fitting
    texts, classes = [sample.texts[i] for i in fitting], sample.classes[fitting]
    by_bucket = documents_by_bucket(texts, classes, config.bucket_bits)
    known = np.flatnonzero(by_bucket.sum(axis=(1, 2)) >= config.min_documents)
    net = first_net(by_bucket[known], known, [(classes == c).sum() for c in (0, 1)], config)
    net.fit(texts, classes, config.steps, np.random.default_rng(config.seed + 1), np.arange(len(texts)))
    raw = np.concatenate([net.logits(piece) for piece in _slices([sample.texts[i] for i in held])])
    langs = np.array([sample.langs[i] or "" for i in held])
    return calibrated(raw, sample.classes[held], langs, sample.share, default, config, net.lighter())


def _counts(dealt: DataFrame, config: NetConfig) -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
    """Known buckets, their (bucket, feature, class) counts of documents, and by class the documents fitted and held back."""
    names = [f"n{i}" for i in range(2 * len(_PREFIXES))]

    def count(batches):
        for _, rows in each_shard(batches):
            own = [r for r in rows if r["home"]]
            fitting = [r for r in own if not r["held"]]
            by_bucket = documents_by_bucket([r["t"] for r in fitting], np.array([r["class"] for r in fitting], dtype=np.int64), config.bucket_bits)
            flat = by_bucket.reshape(len(by_bucket), -1)
            there = np.flatnonzero(flat.any(axis=1))
            sizes = [sum(r["class"] == c and r["held"] == h for r in own) for h in (False, True) for c in (0, 1)]
            columns = np.concatenate([[sizes + [0] * (flat.shape[1] - 4)], flat[there]]).T
            arrays = [pa.array(np.concatenate([[-1], there]).astype(np.int32)), *[pa.array(np.ascontiguousarray(x), pa.int64()) for x in columns]]
            yield pa.RecordBatch.from_arrays(arrays, names=["bucket", *names])

    found = dealt.mapInArrow(lean(count), ", ".join(["bucket int", *[f"{n} bigint" for n in names]]))
    total = found.groupBy("bucket").agg(*[F.sum(n).cast("int").alias(n) for n in names])
    enough = sum((F.col(n) for n in names[1:]), F.col(names[0])) >= config.min_documents
    held = total.where(enough | (F.col("bucket") < 0)).orderBy("bucket").toArrow()
    buckets, numbers = held.column(0).to_numpy(), np.stack([held.column(n).to_numpy() for n in names], axis=1)
    sizes = numbers[buckets < 0].sum(axis=0)[:4].tolist()
    known = buckets >= 0
    return buckets[known].astype(np.int64), numbers[known].reshape(-1, len(_PREFIXES), 2), sizes[:2], sizes[2:]


def _mixed_round(dealt: DataFrame, net: TextNet, turn: int) -> None:
    """Moves `net` by a round of steps in every shard."""
    config, shared = net.config, dealt.sparkSession.sparkContext.broadcast(net)
    names = [f"{kind}{i}" for kind in "vp" for i in range(config.size)]

    def move(batches):
        for shard, rows in each_shard(batches):
            rows = [r for r in rows if not r["held"]]
            if not rows:
                continue
            own = deepcopy(shared.value)
            _, before = own.weights()
            rng = np.random.default_rng([config.seed + 1, shard, turn])
            due = np.arange(len(rows))[turn :: config.rounds]
            own.fit([r["t"] for r in rows], np.array([r["class"] for r in rows], dtype=np.int64), config.steps // config.rounds, rng, due)
            values, past = own.weights()
            touched = (past != before).any(axis=1)
            touched[0] = False
            touched[len(own.embed) :] = True
            moved = np.rint(np.concatenate([values[touched], past[touched]], axis=1).astype(np.float64) * _MIX_GRID).astype(np.int64)
            arrays = [pa.array(np.flatnonzero(touched).astype(np.int32)), *[pa.array(np.ascontiguousarray(x)) for x in moved.T]]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", *names])

    found = dealt.mapInArrow(lean(move), ", ".join(["row int", *[f"{n} bigint" for n in names]]))
    means = found.groupBy("row").agg(*[(F.sum(n) / F.count("*") / _MIX_GRID).cast("float").alias(n) for n in names]).toArrow()
    where, (values, past) = means.column("row").to_numpy(), net.weights()
    for i in range(config.size):
        values[where, i], past[where, i] = means.column(f"v{i}").to_numpy(), means.column(f"p{i}").to_numpy()
    net.set_weights(values, past)
    shared.destroy()
    del means, values, past
    give_back()


def fit_shards(dealt: DataFrame, share: float, config: NetConfig = NetConfig(), default: float = THRESHOLD) -> ToxicityModel:
    """The model of all documents of `labelled_shards`."""
    known, by_bucket, fitted, held = _counts(dealt, config)
    if not min(fitted):
        return ToxicityModel(None, 0.0, share, default, {})
    net = first_net(by_bucket, known, fitted, config)
    for turn in range(config.rounds):
        _mixed_round(dealt, net, turn)
    judging, shared = bool(min(held)), dealt.sparkSession.sparkContext.broadcast(net.lighter())

    def answer(batches):
        for _, rows in each_shard(batches):
            rows = [r for r in rows if r["home"] and r["held"] == judging]
            raw = [shared.value.logits(piece) for piece in _slices([r["t"] for r in rows])]
            columns = [pa.array([r["class"] for r in rows], pa.int32()), pa.array([r["l"] or "" for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate([*raw, np.zeros(0)]))], names=["class", "lang", "raw"])

    def finish(rows: list[dict]) -> ToxicityModel:
        rows.sort(key=lambda r: (r["raw"], r["class"], r["lang"]))
        raw, classes = np.array([r["raw"] for r in rows]), np.array([r["class"] for r in rows], dtype=np.int64)
        return calibrated(raw, classes, np.array([r["lang"] for r in rows]), share, default, config)

    model = fit_in_one_task(dealt.mapInArrow(lean(answer), "class int, lang string, raw double"), finish)
    model.net = net
    shared.destroy()
    return model


def train(docs: DataFrame, labels: DataFrame, config: NetConfig = NetConfig(), label: str = "toxic") -> ToxicityModel:
    """The model of all labelled documents; an id repeated among them gives its least text."""
    marked = marked_labels(labels, label)
    sizes = class_sizes(marked.distinct())
    shards = -(-max(sizes.values(), default=0) // config.shard)
    if shards < 2 or len(sizes) < 2:
        return fit_on_labels(docs, labels, label, SampleBound(config.shard, None), lambda sample: fit_model(sample, config))
    dealt = labelled_shards(docs, marked, shards).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return fit_shards(dealt, share_of(class_sizes(marked)), config)
    finally:
        dealt.unpersist()
        give_back()


def score_texts(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value
        return lambda piece: pa.RecordBatch.from_arrays([piece.column(0), pa.array(own.scores(piece.column(1)))], names=["doc_id", "score"])

    return map_texts(docs, [doc_id], text, "doc_id bigint, score double", make)


def accepted_rows(docs: DataFrame, model: ToxicityModel, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows whose score stays under the threshold of their language; every column stays as it is."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place, lang_place = docs.columns.index(text), docs.columns.index(lang) if lang in docs.columns else None

    def make():
        own = shared.value

        def apply(piece):
            langs = piece.column(lang_place).to_pylist() if lang_place is not None else [None] * piece.num_rows
            return own.scores(piece.column(place)) < own.thresholds(langs)

        return apply

    return filter_rows(docs, text, make)
