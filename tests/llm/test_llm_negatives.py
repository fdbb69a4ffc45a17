"""Hard negatives: the cover tree's invariants, and every result against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pinprice.llm import hard_negatives as H

DDL = "vec_id long, embedding array<float>, label int, rank int, score string, q string"


def brute(rows, picks, k=5, m=3):
    ok = [(i, y, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, y, *_ in rows
          if None not in (i, y) and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, y, q in ok:
        if picks(i):
            asked[i] = min(asked.get(i, (y, q)), (y, q))
    out = []
    for i, (y, q) in asked.items():
        score = lambda v: sum(a * b for a, b in zip(q, v, strict=False))  # noqa: E731, B023
        same = sorted((-score(v), j) for j, z, v in ok if j != i and z == y)[:k]
        other = sorted((-score(v), j) for j, z, v in ok if j != i and z != y)
        for s, j in same:
            hits = [(t, n) for t, n in other if 50 * -s <= 100 * -t <= 95 * -s][:m]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(hits)]
    return sorted(out)


def run(spark, rows, **options):
    got = H.mine(spark.createDataFrame(rows, DDL), F.expr("id % 5 = 0"), **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def vector(rng, n=6):
    return [float(np.float32(x)) for x in rng.normal(size=n)]


@pytest.mark.parametrize("sizes", [dict(block_rows=8, leaf_rows=2, block_group=2, query_group=4), {}])
def test_matches_brute_force(spark, sizes):
    rng = np.random.default_rng(5)
    rows = [(i, vector(rng), i % 3, 0, "x", None) for i in range(80)]
    rows += [(100 + i, rows[i][1], i % 2, 1, None, "") for i in range(12)]                       # ties
    rows += [(3, rows[4][1], 0, 0, "", ""), (5, rows[9][1], 1, 0, "", ""), (5, rows[9][1], 1, 0, "", "")]  # repeated ids
    rows += [(None, rows[0][1], 0, 0, "", ""), (7, rows[0][1], None, 0, "", ""), (200, None, 0, 0, "", ""),
             (205, [1.0, None], 0, 0, "", ""), (210, [math.nan], 0, 0, "", ""), (215, [math.inf], 1, 0, "", ""),
             (220, [], 0, 0, "", ""), (225, [2.0, -1.0], 2, 0, "", ""), (230, [300.0] * 9, -4, 0, "", "")]
    want = brute(rows, lambda i: i % 5 == 0)
    assert len(want) > 40 and run(spark, rows, **sizes) == want


def test_few_rows_large_values_and_empty(spark):
    rows = [(0, [1e6, -2e6], 0, 0, "", ""), (5, [3e6, 1e6], 0, 0, "", ""), (7, [1e6, -1e6], 1, 0, "", ""),
            (8, [4e5, -8e5], 0, 0, "", ""), (9, [3e5, -4e5], 3, 0, "", "")]
    assert run(spark, rows) == brute(rows, lambda i: i % 5 == 0)
    assert run(spark, [(0, [3e38, 3e38], 0, 0, "", ""), (1, [3e38, 3e38], 0, 0, "", "")]) == []
    assert run(spark, rows[:1]) == [] and run(spark, []) == []


def test_one_label_only_and_equal_vectors(spark):
    rows = [(i, [1.0, 1.0], 0, 0, "", "") for i in range(40)]
    assert run(spark, rows) == []
    rows += [(100 + i, [0.75, 0.75], 1, 0, "", "") for i in range(40)]
    assert run(spark, rows, block_rows=16, leaf_rows=2) == brute(rows, lambda i: i % 5 == 0)


@pytest.mark.parametrize("n,leaf", [(1, 4), (200, 1), (300, 8)])
def test_cover_tree_invariants(n, leaf):
    rng = np.random.default_rng(n)
    m = rng.integers(-300, 300, (n, 5))
    m[n // 2:n // 2 + n // 10] = m[0]  # copies
    t = H.cover_tree(m, np.arange(n) % 4, leaf)
    u = H.augment(m[t["order"]])[0]
    assert sorted(t["order"]) == list(range(n)) and np.allclose((u * u).sum(1), 1)
    assert (t["lo"][0], t["hi"][0]) == (0, n)
    for i in range(len(t["lo"])):
        a, b, c = t["lo"][i], t["hi"][i], t["centre"][i]
        assert a <= c < b and (u[a:b] @ u[c] >= math.cos(min(t["radius"][i] + 1e-6, math.pi)) - 1e-9).all()  # covering
        if t["kids"][i]:
            f, k = t["first"][i], t["kids"][i]
            assert t["centre"][f] == c and t["lo"][f] == a and t["hi"][f + k - 1] == b                     # nesting
            assert (t["hi"][f:f + k - 1] == t["lo"][f + 1:f + k]).all()
    centres, levels, parents, _ = H.nets(u, leaf)
    assert all(levels[p] < levels[c] for c, p in enumerate(parents) if p >= 0)
    far = np.sqrt(np.maximum(2 - 2 * u[centres] @ u[centres].T, 0))
    for i in range(1, max(levels) + 1):  # centres of level i and above are apart, and cover those below
        up = [c for c in range(len(centres)) if levels[c] <= i]
        reach = 2 * far[0].max() if len(up) < 2 else min(far[a, b] for a in up for b in up if a != b)
        assert all(far[c, parents[c]] <= 2 * reach + 1e-9 for c in range(len(centres)) if levels[c] == i + 1)


def test_bounds_hold_and_prune_where_data_has_clusters():
    rng = np.random.default_rng(1)
    hearts = rng.normal(size=(20, 8)) * 300
    m = (hearts[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 8)) * 5).astype(np.int64)
    labels = rng.integers(0, 3, 2000)
    t = H.cover_tree(m, labels, 16)
    o = t.pop("order")
    block = {"n": 2000, "dim": 8, "top": t.pop("top"), "ids": np.arange(2000)[o].tobytes(), "labels": labels[o].tobytes(),
             "mat": m[o].tobytes(), **{k: v.tobytes() for k, v in t.items()}}
    forest = H.Forest([block], 8, int(abs(m).max()))
    leaves = int((forest.kids == 0).sum())
    for a in range(0, 2000, 200):
        down, up = forest.bounds(m[a])
        s = forest.mat @ m[a].astype(forest.mat.dtype)
        for i in range(len(up)):
            part = s[forest.lo[i]:forest.hi[i]]
            assert down[i] <= part.min() and part.max() <= up[i]
        (best,), opened = forest.search(m[a], a, int(labels[a]), True, [(None, None)], 5)
        assert opened < leaves / 4 and len(best) == 5


def test_window_is_the_integer_condition():
    for p in range(-50, 200):
        lo, hi = H.window_of(p)
        assert [s for s in range(-100, 300) if 50 * p <= 100 * s <= 95 * p] == list(range(lo, hi + 1))
