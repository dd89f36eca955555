"""Language-model scores from a subword lattice: the probability of a text over all its segmentations.

The pieces of an existing vocabulary and their scores give the first piece weights (1 / (shift - score)). Training words
re-estimate them: a forward-backward pass over the lattice of every distinct training word gives the expected use of each
piece, weighted by the word's count. A text's probability is the product over its words, each with a space mark in front,
and one end; no piece holds an inner space mark, so this equals the sum over all segmentations of the whole text. The
recursion runs in log space over all words of a batch together. Characters without a piece are spelled in bytes.

How it runs: documents are read once and cut into blocks of bounded bytes. A block keeps its distinct words with their
training counts, and per document the block-local ids of its words. The words of all blocks meet in one shuffle; a word
has one row per block, so the commonest one stays far below a partition's share. The counts and word probabilities
return to the blocks, where documents are summed up. Only totals and one number per piece come to the driver.

Defined cases: null and empty texts consist of the end alone; without training documents the first weights count; rows
for which the condition is null are held out; invalid UTF-8 is read as U+FFFD; repeated rows count and are scored
each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm.arrow import bounded
from hourloom.llm.words import Powers
from hourloom.session import materialize

MARK = "▁"
BLOCK_BYTES = 32 << 20
ROUNDS = 2
_LONG = 128
_ODD = 0xD6E8FEB86659FD93
_POWERS = Powers(_ODD)
_SLOTS = 21


@dataclass(frozen=True)
class LatticeConfig:
    """`strength`: pseudo-pieces that the first weights count for; `byte_weight`: first weight of spelling a byte."""

    rounds: int = ROUNDS
    shift: float = 10.0
    strength: float = 1000.0
    byte_weight: float = 1e-3


class Lattice:
    """Pieces and log weights; index n of `log_weight` is a byte (any of 256), index n + 1 the end."""

    def __init__(self, pieces: list[str], scores: np.ndarray, config: LatticeConfig = LatticeConfig()):
        self.pieces = pieces
        first = np.concatenate([1.0 / (config.shift - np.asarray(scores, dtype=np.float64)), [0.0, 0.0]])
        first[-2:] = config.byte_weight * first[:-2].sum()
        self.first = first / first.sum()
        self.log_weight = np.log(self.first)
        self.config = config
        self._index()

    def __getstate__(self):
        """The tables for looking pieces up are larger than the model and are made anew where it arrives."""
        return {k: self.__dict__[k] for k in ("pieces", "first", "log_weight", "config")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._index()

    @classmethod
    def from_model(cls, model_file: str, config: LatticeConfig = LatticeConfig()) -> Lattice:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        kept = [
            i
            for i in range(library.get_piece_size())
            if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))
        ]
        kept = [i for i in kept if MARK not in library.id_to_piece(i)[1:]]
        return cls([library.id_to_piece(i) for i in kept], np.array([max(library.get_score(i), -1e6) for i in kept]), config)

    def _index(self):
        """Places of the pieces, and an open hash table over their rolling hashes for looking up arrays of substrings."""
        self.place = {p: i for i, p in enumerate(self.pieces)}
        self.longest = max(map(len, self.pieces))
        points, first = _code_points(self.pieces)
        sums = _sums(points, _POWERS.upto(len(points) + 1)[0])
        down = _POWERS.upto(len(points) + 1)[1]
        hashes = _finish((sums[first[1:]] - sums[first[:-1]]) * down[first[:-1]])
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two pieces share a hash")
        self.slots = np.full(1 << _SLOTS, -1, dtype=np.int32)
        self.keys = np.zeros(1 << _SLOTS, dtype=np.uint64)
        pending, at = np.arange(len(hashes)), (hashes >> np.uint64(64 - _SLOTS)).astype(np.int64)
        self.probes = 0
        while len(pending):
            self.probes += 1
            free = self.slots[at] < 0
            _, chosen = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            chosen = chosen[free[chosen]]
            self.slots[at[chosen]] = pending[chosen]
            self.keys[at[chosen]] = hashes[pending[chosen]]
            rest = np.setdiff1d(np.arange(len(pending)), chosen)
            pending, at = pending[rest], (at[rest] + 1) % (1 << _SLOTS)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Piece per hash, -1 if none."""
        at = (hashes >> np.uint64(64 - _SLOTS)).astype(np.int64)
        out = np.where(self.keys[at] == hashes, self.slots[at], -1)
        for probe in range(1, self.probes):
            later = (at + probe) % (1 << _SLOTS)
            out = np.where((out < 0) & (self.keys[later] == hashes), self.slots[later], out)
        return out

    # --- recursion --------------------------------------------------------------------------------------------------

    def _edges(self, words: list[str]):
        """Words by falling length, and per end position and piece length the pieces that end there."""
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        points, first = _code_points([MARK + words[i] for i in order])
        lengths = np.diff(first)
        up, down = _POWERS.upto(len(points) + 1)
        sums, begin = _sums(points, up), first[:-1]
        spelled = np.where(points < 0x80, 1, np.where(points < 0x800, 2, np.where(points < 0x10000, 3, 4)))
        spell = spelled * (self.log_weight[len(self.pieces)] - np.log(256.0))
        steps = []
        for t in range(1, int(lengths.max(initial=0)) + 1):
            live = int(np.searchsorted(-lengths, -t, "right"))
            at = begin[:live] + t
            for size in range(1, min(t, self.longest) + 1):
                piece = self.lookup(_finish((sums[at] - sums[at - size]) * down[at - size]))
                if size == 1:
                    weight = np.where(piece >= 0, self.log_weight[piece], spell[at - 1])
                    steps.append((t, size, np.arange(live), np.where(piece >= 0, piece, len(self.pieces)), weight))
                else:
                    rows = np.flatnonzero(piece >= 0)
                    if len(rows):
                        steps.append((t, size, rows, piece[rows], self.log_weight[piece[rows]]))
        return np.array(order, dtype=np.int64), lengths, spelled, begin, steps

    def _forward(self, words: list[str]):
        edges = self._edges(words)
        order, lengths, _, _, steps = edges
        alpha = np.full((int(lengths.max(initial=0)) + 1, len(words)), -np.inf)
        alpha[0] = 0.0
        for t, size, rows, _, weight in steps:
            alpha[t, rows] = np.logaddexp(alpha[t, rows], alpha[t - size, rows] + weight)
        return edges, alpha

    def log10(self, words: list[str]) -> np.ndarray:
        """Log10 of each word's probability, a space mark in front."""
        out = np.zeros(len(words))
        short = [i for i, w in enumerate(words) if len(w) < _LONG]
        if short:
            (order, lengths, *_), alpha = self._forward([words[i] for i in short])
            out[np.array(short)[order]] = alpha[lengths, np.arange(len(short))]
        for i, w in enumerate(words):
            if len(w) >= _LONG:
                out[i] = self._long(w)[0][-1]
        return out / np.log(10.0)

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected use of every piece, of bytes, and of the end (zero) over words that occur `counts` times."""
        total = np.zeros(len(self.log_weight))
        short = [i for i, w in enumerate(words) if len(w) < _LONG]
        if short:
            (order, lengths, spelled, begin, steps), alpha = self._forward([words[i] for i in short])
            n = np.asarray(counts, dtype=np.float64)[np.array(short)][order]
            beta = np.full_like(alpha, -np.inf)
            beta[lengths, np.arange(len(short))] = 0.0
            whole = alpha[lengths, np.arange(len(short))]
            for t, size, rows, piece, weight in reversed(steps):
                through = weight + beta[t, rows]
                beta[t - size, rows] = np.logaddexp(beta[t - size, rows], through)
                use = np.exp(alpha[t - size, rows] + through - whole[rows]) * n[rows]
                if size == 1:
                    use = np.where(piece == len(self.pieces), use * spelled[begin[rows] + t - 1], use)
                total += np.bincount(piece, weights=use, minlength=len(total))
        for i, w in enumerate(words):
            if len(w) >= _LONG:
                alpha, arcs = self._long(w)
                beta = np.full(len(alpha), -np.inf)
                beta[-1] = 0.0
                for low, high, piece, weight, bytes_ in reversed(arcs):
                    through = weight + beta[high]
                    beta[low] = np.logaddexp(beta[low], through)
                    total[piece] += np.exp(alpha[low] + through - alpha[-1]) * counts[i] * bytes_
        return total

    def _long(self, word: str):
        """The same recursion for one long word: alpha, and its arcs (from, to, piece, weight, bytes)."""
        text, byte = MARK + word, len(self.pieces)
        alpha, arcs = np.full(len(text) + 1, -np.inf), []
        alpha[0] = 0.0
        for high in range(1, len(text) + 1):
            for low in range(max(0, high - self.longest), high):
                piece = self.place.get(text[low:high])
                bytes_ = 1
                if piece is None:
                    if high - low > 1:
                        continue
                    bytes_ = len(text[low:high].encode())
                    piece, weight = byte, bytes_ * (self.log_weight[byte] - np.log(256.0))
                else:
                    weight = self.log_weight[piece]
                arcs.append((low, high, piece, weight, bytes_))
                alpha[high] = np.logaddexp(alpha[high], alpha[low] + weight)
        return alpha, arcs

    def learned(self, use: np.ndarray) -> Lattice:
        """The same lattice with weights from the expected use and the first weights as pseudo-pieces."""
        new = object.__new__(Lattice)
        new.__dict__.update(self.__dict__)
        weights = use + self.config.strength * self.first
        new.log_weight = np.log(weights / weights.sum())
        return new


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    return points, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _sums(points: np.ndarray, up: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum((points + np.uint64(1)) * up[: len(points)], out=out[1:])
    return out


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_ODD)
    return h ^ (h >> np.uint64(29))


# --- Spark ----------------------------------------------------------------------------------------------------------


class _LocalIds(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


_CUT = "block bigint, doc_id bigint, held_out boolean, ids array<int>, counts array<int>, word binary, local int, trained bigint"


def _cut_blocks(batches: Iterable[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Document rows (ids, counts) and word rows (word, local, trained) of every block."""
    from pyspark import TaskContext

    block, local, trained, size = TaskContext.get().partitionId() << 32, _LocalIds(), np.zeros(0, np.int64), 0

    def rows(n, **columns):
        types = dict(
            block=pa.int64(), doc_id=pa.int64(), held_out=pa.bool_(), ids=pa.list_(pa.int32()), counts=pa.list_(pa.int32()), word=pa.binary(), local=pa.int32(), trained=pa.int64()
        )
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in types.items()], names=list(types))

    def word_rows():
        words = list(local)
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            n = len(part)
            yield rows(
                n,
                block=pa.array(np.full(n, block)),
                word=pa.array(part, pa.binary()),
                local=pa.array(np.arange(at, at + n, dtype=np.int32)),
                trained=pa.array(trained[at : at + n]),
            )

    for piece in bounded(batches, 2):
        ids, counts = [], []
        held = piece.column(1).to_pylist()
        texts = piece.column(2).cast(pa.large_binary()).to_pylist()
        for text, out in zip(texts, held):
            words = (text or b"").lower().split()
            size += len(text or b"")
            own, n = np.unique(np.fromiter((local[w] for w in words), dtype=np.int32, count=len(words)), return_counts=True)
            if len(trained) < len(local):
                trained = np.concatenate([trained, np.zeros(max(len(local) - len(trained), len(trained)), np.int64)])
            if out is False:
                trained[own] += n
            ids.append(own)
            counts.append(n.astype(np.int32))
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32))
        yield rows(
            piece.num_rows,
            block=pa.array(np.full(piece.num_rows, block)),
            doc_id=piece.column(0),
            held_out=piece.column(1),
            ids=pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids))),
            counts=pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(counts))),
        )
        if size >= block_bytes:
            yield from word_rows()
            block, local, trained, size = block + 1, _LocalIds(), np.zeros(0, np.int64), 0
    yield from word_rows()


def _total_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, block, local, trained) sorted by word get the word's count over all blocks; the first is marked."""
    held: list[pa.RecordBatch] = []

    def finished(part: pa.RecordBatch):
        words = part.column(0)
        n = part.num_rows
        new = np.ones(n, dtype=bool)
        if n > 1:
            new[1:] = np.asarray(pa.compute.not_equal(words.slice(1), words.slice(0, n - 1)))
        run = np.cumsum(new) - 1
        totals = np.bincount(run, weights=part.column(3).to_numpy(), minlength=run[-1] + 1).astype(np.int64)
        return pa.RecordBatch.from_arrays([words, part.column(1), part.column(2), pa.array(totals[run]), pa.array(new)], names=["word", "block", "local", "count", "leads"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last = batch.column(0)[batch.num_rows - 1]
        if batch.column(0)[0] == last:
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        words = whole.column(0)
        cut = int(np.flatnonzero(np.asarray(pa.compute.not_equal(words, last)))[-1]) + 1
        yield finished(whole.slice(0, cut))
        held = [whole.slice(cut)]
    if held:
        yield finished(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _word_texts(column: pa.Array) -> list[str]:
    return [w.decode("utf-8", "replace") for w in column.to_pylist()]


def _expected_use(batches: Iterable[pa.RecordBatch], lattice: Lattice) -> Iterator[pa.RecordBatch]:
    use = np.zeros(len(lattice.log_weight))
    for batch in batches:
        if batch.num_rows:
            use += lattice.expected(_word_texts(batch.column(0)), batch.column(1).to_numpy())
    at = np.flatnonzero(use)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(use[at])], names=["piece", "use"])


def _word_scores(batches: Iterable[pa.RecordBatch], lattice: Lattice) -> Iterator[pa.RecordBatch]:
    """Rows (word, block, local, count) by word; a word is scored once per batch."""
    for batch in batches:
        if batch.num_rows:
            coded = batch.column(0).dictionary_encode()
            scores = lattice.log10(_word_texts(coded.dictionary))
            values = pa.array(scores[coded.indices.to_numpy()])
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), values], names=["block", "local", "count", "log10"])


def score_texts(docs: DataFrame, lattice: Lattice, held_out, block_bytes: int = BLOCK_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    `held_out` is a condition on the documents; the others train. The base score is a smoothed word count model.
    """
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(held_out, F.lit(True)).alias("held_out"), F.col(text).alias("text"))
    cut = materialize(source.mapInArrow(lambda batches: _cut_blocks(batches, block_bytes), _CUT), "blocks")
    texts = cut.where("ids is not null").select("block", "doc_id", "held_out", "ids", "counts")
    words = cut.where("word is not null").select("word", "block", "local", "trained")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = words.repartition(partitions, "word").sortWithinPartitions("word", "block")
    counted = materialize(counted.mapInArrow(_total_counts, "word binary, block bigint, local int, count bigint, leads boolean"), "counts")

    ends = texts.where("not held_out").count()
    known = counted.where("leads and count > 0")
    tokens, kinds = known.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    tokens, kinds = tokens + ends, kinds + (ends > 0)
    for _ in range(lattice.config.rounds if ends else 0):
        used = known.select("word", "count").mapInArrow(lambda batches, now=lattice: _expected_use(batches, now), "piece int, use double")
        use = np.zeros(len(lattice.log_weight))
        for r in used.groupBy("piece").agg(F.sum("use").alias("use")).collect():
            use[r["piece"]] = r["use"]
        use[-1] = ends
        lattice = lattice.learned(use)

    answers = counted.select("word", "block", "local", "count").mapInArrow(
        lambda batches, now=lattice: _word_scores(batches, now), "block bigint, local int, count bigint, log10 double"
    )
    floor = np.log10(tokens + 0.5 * (kinds + 1))
    end_base, end_score = np.log10(ends + 0.5) - floor, lattice.log_weight[-1] / np.log(10.0)
    end_known = int(ends > 0)

    def sum_up(left: pa.Table, right: pa.Table) -> pa.Table:
        local = right["local"].to_numpy()
        count, score = np.zeros(len(local), np.int64), np.zeros(len(local))
        count[local], score[local] = right["count"].to_numpy(), right["log10"].to_numpy()
        base = np.log10(count + 0.5) - floor
        out = []
        lists = (left[c].combine_chunks() for c in ("ids", "counts"))
        ids, n = (x.flatten().to_numpy() for x in lists)
        sizes = pa.compute.list_value_length(left["ids"]).to_numpy()
        first = np.cumsum(sizes) - sizes
        for a, size in zip(first.tolist(), sizes.tolist()):
            i, c = ids[a : a + size], n[a : a + size]
            out.append((int(c.sum()) + 1, int(c[count[i] > 0].sum()) + end_known, float(c @ base[i]) + end_base, float(c @ score[i]) + end_score))
        columns = list(zip(*out)) or [()] * 4
        kinds_of = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        made = [pa.array(c, k) for c, k in zip(columns, kinds_of)]
        return pa.table(
            {
                "doc_id": left["doc_id"],
                "held_out": left["held_out"],
                "n_tokens": made[0],
                "n_known": made[1],
                "train_tokens": pa.array(np.full(left.num_rows, tokens, dtype=np.int64)),
                "base_score": made[2],
                "score": made[3],
            }
        )

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(sum_up, schema)
