"""Exact top-k search against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import types as T

from daygrid.llm import topk

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), *[T.StructField(c, T.StringType()) for c in ("block", "turn", "kind", "query", "score", "rank", "vector")]])


def brute(rows, every, k):
    """Best k of all rows by plain integer products."""
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for i, q in whole:
        if i is None or i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v)), math.inf if j is None else j) for j, v in whole if j != i)
        out[i, tuple(q)] = [(r, None if j == math.inf else j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted((i, *x) for (i, _), rows in out.items() for x in rows)


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, v, *"xxxxxxx") for i, v in rows], SCHEMA).repartition(3)
    none_last = lambda r: tuple(math.inf if x is None else x for x in r)
    return sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, **how).collect()), key=none_last)


@pytest.mark.parametrize("cells", [{}, {"cell_components": 200, "cell_queries": 3}])
def test_top_k_against_brute_force(spark, cells):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(0, 0.2, 8).tolist()) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(30)]  # a very common vector: ties go by id
    rows += [(400, rows[3][1]), (401, None), (402, [None] * 8), (403, [math.nan] * 8), (404, [math.inf] + [0.0] * 7), (None, rows[10][1]), (410, [0.0] * 8), (420, []), (421, [5.0, -3.0]), (7, rows[7][1])]
    assert run(spark, rows, every=10, k=5, **cells) == brute(rows, 10, 5)


def test_large_components_stay_exact(spark):
    rows = [(0, [3e9, -2e9]), (1, [3e9, -2e9]), (2, [3e9, -1.9e9]), (3, [1.0, 1.0])]
    got = [(i, s) for _, _, i, s in run(spark, rows, every=50, k=3)]
    exact = {i: sum(math.floor(256 * float(np.float32(a))) * math.floor(256 * float(np.float32(b))) for a, b in zip(rows[0][1], v)) for i, v in rows[1:]}
    assert got == [(i, min(exact[i], 2**63 - 1)) for i in (1, 2, 3)]


def test_few_rows_and_none(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, [1.0]), (1, [-1.0])]) == [(0, 1, 1, -65536)]
    assert run(spark, [(50, [1.0]), (50, [1.0]), (50, [2.0]), (1, [1.0])]) == [(50, 1, 1, 65536), (50, 1, 1, 131072)]


def test_stops_before_the_end():
    rng = np.random.default_rng(1)
    vectors = (rng.pareto(1.5, (4000, 4)) * 256).astype(np.int64)
    lists = topk.Lists(np.arange(4000), vectors)
    ids, scores = lists.top(-1, np.array([3, 0, 5, 1]), 5)
    every = vectors @ [3, 0, 5, 1]
    assert scores.tolist() == sorted(every, reverse=True)[:5] and (every[ids] == scores).all() and lists.read < 1000
