"""Exact top-k search against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pinprice.llm import topk_search as S

DDL = "vec_id long, embedding array<float>, rank int, score string"


def brute(rows, picks, k):
    ok = []
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    queries = {}
    for i, q in ok:
        if picks(i):
            queries[i] = min(queries.get(i, q), q)
    out = []
    for i, q in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in ok if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


def run(spark, rows, k=5, **options):
    df = spark.createDataFrame(rows, DDL)
    got = S.top_k(df, F.expr("id % 5 = 0"), k=k, **options)
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("blocks", [dict(block_rows=3, block_group=2, query_group=4), {}])
def test_matches_brute_force(spark, blocks):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)], 0, "x") for i in range(60)]
    rows += [(100 + i, rows[i][1], 1, None) for i in range(10)]                      # ties
    rows += [(3, rows[4][1], 0, ""), (5, rows[9][1], 0, ""), (None, rows[0][1], 0, "")]  # repeated and null ids
    rows += [(200, None, 0, ""), (205, [1.0, None], 0, ""), (210, [math.nan], 0, ""), (215, [math.inf], 0, ""),
             (220, [], 0, ""), (225, [2.0, -1.0], 0, ""), (230, [300.0] * 9, 0, "")]
    assert run(spark, rows, **blocks) == brute(rows, lambda i: i % 5 == 0, 5)


def test_few_candidates_large_values_and_empty(spark):
    rows = [(0, [1e6, -2e6], 0, ""), (5, [3e6, 1e6], 0, ""), (7, [-1e6, -1e6], 0, "")]
    assert run(spark, rows) == brute(rows, lambda i: i % 5 == 0, 5)
    assert run(spark, rows[:1]) == []
    assert run(spark, []) == []


def test_types_hold_every_sum():
    assert S.exact_dtype(64, 128, 256) is np.float32
    assert S.exact_dtype(64, 2**20, 2**20) is np.float64
    assert S.exact_dtype(64, 2**30, 2**30) is object
