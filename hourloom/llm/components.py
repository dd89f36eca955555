"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.session import materialize


def _towards_least(edges: DataFrame) -> DataFrame:
    """Every edge of u, re-hung from u to the least node that u knows."""
    least = edges.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _towards_least(both).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    hung = _towards_least(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    own = hung.select("u", F.col("low").alias("v"))
    rest = hung.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return own.unionByName(rest).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node of a link between two different nodes; root is the least node of its component.

    Minima are taken map-side and each node passes on one row per link, so a hub is never gathered. Every round
    is written to the shared folder, which cuts the lineage and survives lost executors.
    """
    edges = links.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v").distinct()
    edges = materialize(edges, "links")
    state = _state(edges)
    while state[0]:
        edges = materialize(_small_star(_large_star(edges)), "links")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
