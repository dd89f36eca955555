"""Training-data preparation over `documents`: each stage takes all that its predecessor kept.

toxicity        rows that the classifier rejects (threshold of their language) go
near copies     one row of every group of near copies (5-word Jaccard similarity of at least 0.8) stays
decontamination rows that hold a benchmark item go
personal data   found spans are replaced by their kind; every row stays
tokens          every row gets its SentencePiece ids and the text that they decode to
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.llm import decontaminate, near_dup, pii, subword, toxicity
from hourloom.session import materialize

VOCABULARY = "piece_bpe_32k.model"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.accepted_rows(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one_per_group(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_rows(docs, read(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact_rows(docs, pii.train(docs))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = subword.encode_texts(docs, public_tokenizers.path(VOCABULARY))
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("personal_data", redact_personal_data),
    ("tokens", encode_tokens),
]

# Trained models and groups of near copies are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again as the next one's input."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
