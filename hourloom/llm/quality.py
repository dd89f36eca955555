"""Quality by compression: zstandard dictionaries of good and of bad labelled text, and a calibrated size difference.

A text is cut into blocks of `block` bytes, each compressed with both dictionaries. The difference of the two totals,
divided by the length of the text, is turned into a score by a logistic curve fitted on sample documents that did not
enter the dictionaries. Text that either dictionary (or a block itself) explains equally well has a difference near zero,
which the curve learns as bad: repeated text compresses alike with both.

Defined cases: null and empty texts have a difference of zero; without labels of both classes every score is the share of
class 1 (0 without labels); repeated rows are scored each; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from hourloom.llm.arrow import map_texts, utf8
from hourloom.llm.training import Sample, SampleBound, calibrate, fit_on_labels, sigmoid

THRESHOLD = 0.7


@dataclass(frozen=True)
class CompressionConfig:
    dictionary_bytes: int = 65_536
    block: int = 1024
    level: int = 3
    sample: SampleBound = field(default_factory=lambda: SampleBound(per_class=2000))


def blocks_of(text: bytes, size: int) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)]


def make_dictionary(texts: list[str], config: CompressionConfig) -> bytes:
    """Trained dictionary; a small sample serves as it is."""
    samples = [b for t in texts for b in blocks_of(t.encode(), config.block)]
    try:
        return zstandard.train_dictionary(config.dictionary_bytes, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-config.dictionary_bytes :]


class SizeDifference:
    """(bytes with the bad dictionary - bytes with the good one) / bytes of the text."""

    def __init__(self, good: bytes, bad: bytes, config: CompressionConfig):
        def compressor(raw):
            parameters = zstandard.ZstdCompressionParameters.from_level(config.level, write_content_size=False, write_dict_id=False, write_checksum=False)
            dictionary = zstandard.ZstdCompressionDict(raw) if raw else None
            return zstandard.ZstdCompressor(compression_params=parameters, dict_data=dictionary)

        self.good, self.bad, self.block = compressor(good), compressor(bad), config.block

    def __call__(self, text: bytes) -> float:
        good, bad = self.good.compress, self.bad.compress
        gap = sum(len(bad(b)) - len(good(b)) for b in blocks_of(text, self.block))
        return gap / len(text) if text else 0.0


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    offset: float
    config: CompressionConfig
    share: float | None = None

    def scorer(self):
        if self.share is not None:
            return lambda texts: np.full(len(texts), self.share)
        difference = SizeDifference(self.good, self.bad, self.config)
        return lambda texts: sigmoid(self.slope * np.array([difference(t) for t in texts], dtype=np.float64) + self.offset)


def fit_model(sample: Sample, config: CompressionConfig = CompressionConfig()) -> QualityModel:
    if len(np.unique(sample.classes)) < 2:
        return QualityModel(b"", b"", 0.0, 0.0, config, sample.share)
    fitting, held = sample.split()
    if len(np.unique(sample.classes[held])) < 2:
        held = fitting
    good, bad = (make_dictionary([sample.texts[i] for i in fitting if sample.classes[i] == c], config) for c in (1, 0))
    difference = SizeDifference(good, bad, config)
    raw = np.array([difference(sample.texts[i].encode()) for i in held])
    slope, offset = calibrate(raw, sample.classes[held], sample.share)
    return QualityModel(good, bad, slope, offset, config)


def train(docs: DataFrame, labels: DataFrame, config: CompressionConfig = CompressionConfig(), label: str = "quality") -> QualityModel:
    return fit_on_labels(docs, labels, label, config.sample, lambda sample: fit_model(sample, config))


def score_texts(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text."""

    def make():
        scores = model.scorer()
        return lambda piece: pa.RecordBatch.from_arrays([piece.column(0), pa.array(scores(utf8(piece, 1)))], names=["doc_id", "score"])

    return map_texts(docs, [doc_id], text, "doc_id bigint, score double", make)
