"""Prepared tables, fitted models and forecast exports on shared storage."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def write_prepared(tables: Mapping[str, DataFrame], root: str) -> None:
    """One parquet folder per table; a retrain overwrites."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{root}/{name}")


def read_prepared(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def save_model(model: PipelineModel, features: list[str], path: str) -> None:
    """Fitted stages plus the ordered feature names."""
    model.write().overwrite().save(f"{path}/stages")
    spark = SparkSession.active()
    rows = [(i, name) for i, name in enumerate(features)]
    spark.createDataFrame(rows, "position int, feature string").coalesce(1).write.mode("overwrite").parquet(
        f"{path}/features"
    )


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, list[str]]:
    names = spark.read.parquet(f"{path}/features").orderBy("position").collect()
    return PipelineModel.load(f"{path}/stages"), [r["feature"] for r in names]


def export_csv(forecast: DataFrame, path: str) -> None:
    """CSV files with a header line."""
    forecast.write.mode("overwrite").option("header", True).csv(path)
