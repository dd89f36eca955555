import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourloom.llm import topk


def plain(rows, k):
    good = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, q in good:
        if i % 10 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in good if j != i and len(c) == len(q))
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])}
    return out


def answer(spark, rows, k=10, **parameters):
    table = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id bigint, embedding array<float>, score double").repartition(3)
    return topk.top_k(table, F.col("vec_id") % 10 == 0, k, **parameters).collect()


@pytest.mark.parametrize("dims,scale,block_bytes", [(64, 1.0, 1 << 24), (5, 0.002, 1 << 24), (40, 1.0, 1000), (3, 3e5, 1 << 24)])
def test_matches_brute_force(spark, dims, scale, block_bytes):
    rng = random.Random(dims)
    centres = [[rng.gauss(0, scale) for _ in range(dims)] for _ in range(4)]
    rows = [(i, [x + rng.gauss(0, scale / 4) for x in rng.choice(centres)]) for i in range(300)]
    got = answer(spark, rows, block_bytes=block_bytes)
    assert {tuple(r) for r in got} == plain(rows, 10) and len(got) == 300


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (10, None), (20, []), (30, [None, 1.0]), (40, [float("nan"), 1.0]), (50, [float("inf"), 1.0])]
    rows += [(None, [1.0, 1.0]), (3, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (60, [1.0, 2.0, 3.0])]
    got = sorted(tuple(r) for r in answer(spark, rows))
    assert got == [(0, 1, 2, 5 * 1024**2), (0, 2, 2, 5 * 1024**2), (0, 3, 3, 5 * 1024**2)]
    assert answer(spark, []) == [] and answer(spark, [(1, [1.0])]) == []
