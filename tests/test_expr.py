import math

import pytest
from pyspark.sql import functions as F

from pinprice.functions.expr import (
    PIN_CHARGE,
    ZONE_CHARGE,
    delivered_price,
    dist_key,
    distance_text,
    normalize_zone,
    price_path,
    round_half_up,
)

# (buyingPrice, charge, expected) - golden rows of the rounding rule
GOLDEN = [
    (100, 17.09, 119),
    (100, 35.99, 138),
    (100, 0.0, 102),
    (75, 0.0, 77),       # 76.5 -> 77 (banker's rounding would give 76)
    (75, 17.09, 94),
    (75, 35.99, 112),    # 112.49000000000001
    (90, 138.15, 230),
    (120, 68.4, 191),
]


@pytest.mark.parametrize("b,charge,expected", GOLDEN)
def test_delivered_price_golden(spark, b, charge, expected):
    df = spark.createDataFrame([(b, charge)], "b INT, c DOUBLE")
    got = df.select(delivered_price("b", F.col("c")).alias("p")).first()["p"]
    assert got == expected
    # the same with a literal charge
    got2 = df.select(delivered_price("b", charge).alias("p")).first()["p"]
    assert got2 == expected
    # and with plain IEEE arithmetic in the same order
    assert math.floor(b + 0.02 * b + charge + 0.5) == expected


def test_round_half_up_edges(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (118.5,), (76.5,), (0.49,)], "x DOUBLE")
    got = [r[0] for r in df.select(round_half_up("x")).collect()]
    assert got == [3, -2, 119, 77, 0]


def test_result_type_is_bigint(spark):
    df = spark.createDataFrame([(1,)], "b INT")
    assert dict(df.select(delivered_price("b").alias("p")).dtypes)["p"] == "bigint"


def test_default_charges():
    assert PIN_CHARGE == 17.09 and ZONE_CHARGE == 35.99


def test_text_helpers(spark):
    df = spark.createDataFrame([(504273, 504204, 30.0, " asia "), (None, 1, 1e7, None)],
                               "s INT, d INT, x DOUBLE, z STRING")
    r = df.select(dist_key("s", "d").alias("k"), distance_text("x").alias("t"),
                  normalize_zone("z").alias("z"), price_path("d").alias("p")).collect()
    assert r[0]["k"] == "504273_504204" and r[0]["t"] == "30.0" and r[0]["z"] == "ASIA"
    assert r[0]["p"] == "prices.504204"
    assert r[1]["k"] is None and r[1]["t"] == "1.0E7" and r[1]["z"] is None


def test_sql_functions(spark):
    from pinprice.functions.sql import register_sql_functions

    names = register_sql_functions(spark)
    assert names == ["pinprice_round_half_up", "pinprice_delivered_price"]
    for b, c, want in GOLDEN:
        got = spark.sql(f"SELECT pinprice_delivered_price(CAST({b} AS INT), CAST({c} AS DOUBLE)) AS p").first()["p"]
        assert got == want
    assert spark.sql("SELECT pinprice_round_half_up(-2.5D) AS r").first()["r"] == -2
