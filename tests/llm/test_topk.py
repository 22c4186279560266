"""Exact top-k search against all products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from treesift.llm.topk_search import top_k

SCHEMA = "vec_id bigint, embedding array<double>, score string, dim string"


def brute(rows, k, every=50, factor=256):
    sound = []
    for i, v, *_ in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            sound.append((i, [math.floor(factor * x) for x in v]))
    out = []
    for a, (i, q) in enumerate(sound):
        if i is None or i % every:
            continue
        scored = [
            (-sum(x * y for x, y in zip(q, c)), j is None, j or 0, j)
            for b, (j, c) in enumerate(sound)
            if a != b and len(c) == len(q)
        ]
        out += [(i, rank, j, -s) for rank, (s, _, _, j) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def found(spark, rows, k=5, **options):
    frame = spark.createDataFrame([(i, v, "clash", "clash") for i, v in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in top_k(frame, F.col("vec_id") % 50 == 0, k, **options).collect()), key=repr)


@pytest.mark.parametrize("slices,block_rows", [(1, 64), (2, 7), (3, 50), (4, 4096)])
def test_random_vectors(spark, slices, block_rows):
    rng = np.random.default_rng(slices)
    rows = [(int(i), rng.normal(size=9).tolist()) for i in range(400)]
    assert found(spark, rows, slices=slices, block_rows=block_rows) == brute(rows, 5)


def test_few_lists_are_visited_again(spark):
    """Clusters: the cutoff lies above what other lists end with, and ties abound."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 12))
    rows = [(i, (centres[i % 8] * 4 + rng.integers(-1, 2, 12) / 256).tolist()) for i in range(500)]
    assert found(spark, rows, block_rows=40) == brute(rows, 5)


def test_one_very_common_vector(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else rng.normal(size=3).tolist()) for i in range(600)]
    assert found(spark, rows, block_rows=32) == brute(rows, 5)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, -2.0]),
        (0, [1.0, -2.0]),
        (0, [3.0, 0.001]),
        (50, [-1.0, -1.0]),
        (100, None),
        (150, [1.0, None]),
        (200, [nan, 1.0]),
        (250, [inf, 1.0]),
        (300, []),
        (7, []),
        (350, [1.0, 2.0, 3.0]),
        (None, [1.0, -2.0]),
        (None, [1.0, -2.0]),
        (3, [1.0, -2.0]),
        (-50, [-0.001, 0.0]),
        (2, [1e-9, -1e-9]),
    ]
    for k in (1, 3, 5, 50):
        assert found(spark, rows, k, block_rows=3) == brute(rows, k)
    assert found(spark, [(0, [1.0])]) == []
    assert found(spark, []) == []


def test_scores_beyond_doubles(spark):
    rows = [(i, [float(2**20 + i), -float(2**20), 1.0 + i]) for i in range(0, 300, 10)]
    assert max(abs(r[3]) for r in brute(rows, 3)) > 1 << 53
    assert found(spark, rows, 3) == brute(rows, 3)


def test_bad_options(spark):
    with pytest.raises(ValueError):
        found(spark, [(0, [1.0])], k=0)
