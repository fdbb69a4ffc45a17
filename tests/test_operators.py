from collections import Counter

from pyspark.sql import functions as F

from conftest import rows
from pinprice.operators.aggregate import argmin, last_per_key, top_k
from pinprice.operators.joins import expand_join, fits, grid_join, join_small


def test_fits(spark):
    df = spark.range(10)
    assert fits(df, 10) and not fits(df, 9)


def test_grid_join_is_exact_with_hot_key_and_duplicates(spark):
    left = spark.createDataFrame([("hot", i % 7) for i in range(300)] + [("cold", 1), ("cold", 1)],
                                 "k STRING, a INT")
    right = spark.createDataFrame([("hot", j) for j in range(40)] + [("cold", 9), ("none", 0)],
                                  "k STRING, b INT")
    got = Counter(tuple(r) for r in grid_join(left, right, ["k"], 5, 3).select("k", "a", "b").collect())
    want = Counter(tuple(r) for r in left.join(right, "k").select("k", "a", "b").collect())
    assert got == want and sum(got.values()) == 300 * 40 + 2


def test_expand_and_small_joins_agree(spark):
    left = spark.createDataFrame([(z, i) for z in "ab" for i in range(20)], "z STRING, i INT")
    right = spark.createDataFrame([(z, p) for z in "abc" for p in range(5)], "z STRING, p INT")
    a = rows(expand_join(left, right, "z").select("z", "i", "p"))
    b = rows(expand_join(left, right, "z", max_broadcast_rows=2).select("z", "i", "p"))
    c = rows(join_small(left, right, "z", max_broadcast_rows=2).select("z", "i", "p"))
    assert a == b == c and len(a) == 200


def test_argmin_total_order_and_top_k(spark):
    df = spark.createDataFrame([("x", 3, 1, "a"), ("x", 1, 5, "b"), ("x", 1, 2, "c"), ("y", 7, 0, "d")],
                               "k STRING, p INT, q INT, tag STRING")
    assert rows(argmin(df, ["k"], ["p", "q"], ["tag"])) == [("x", 1, 2, "c"), ("y", 7, 0, "d")]
    t = rows(top_k(df, ["k"], ["p", "q"], 2).select("k", "rank", "tag"))
    assert t == [("x", 1, "c"), ("x", 2, "b"), ("y", 1, "d")]
    last = rows(last_per_key(df, ["k"], "p", ["tag"]))
    assert last == [("x", 3, "a"), ("y", 7, "d")]


def test_argmin_null_fields_sort_first(spark):
    df = spark.createDataFrame([("x", 1, None), ("x", 1, 0)], "k STRING, p INT, pin INT")
    assert rows(argmin(df, ["k"], ["p", "pin"])) == [("x", 1, None)]
    assert df.select(F.lit(1)).count() == 2


def test_packed_argmin_matches_struct_order(spark):
    import random

    random.seed(7)
    vals = [-2**31, -5, -1, 0, 1, 2, 2**31 - 1]
    data = [("k%d" % random.randrange(6), random.choice(vals), random.choice(vals)) for _ in range(400)]
    df = spark.createDataFrame(data, "k STRING, a INT, b INT")
    packed = argmin(df, ["k"], ["a", "b"], not_null=True)
    assert rows(packed) == rows(argmin(df, ["k"], ["a", "b"]))
    want = {}
    for k, a, b in data:
        want[k] = min(want.get(k, (a, b)), (a, b))
    assert rows(packed) == sorted((k,) + v for k, v in want.items())
    p = io_plan(packed)
    assert "HashAggregate" in p and "SortAggregate" not in p


def io_plan(df):
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()
