from pyspark.sql import functions as F

from conftest import DIST_DDL, OFFER_DDL, PIN_DDL, PROD_DDL, REQ_DDL, rows
from pinprice.plans.offers import (
    argmin_per_key,
    eligible_offers,
    min_price_for_pin,
    min_price_for_pins,
    min_price_for_zone,
    min_quote_for_pins,
    top_k_offers,
)
from pinprice.sources.tables import offers_from_documents, to_documents

Z = "SOUTH"


def _offers(mk, rs):
    return mk([(Z, 1, pn, b, s, q) for (pn, b, s, q) in rs], OFFER_DDL)


def test_eligibility(mk):
    o = _offers(mk, [(10, None, 5.0, 3), (11, 50, 5.0, None), (12, 50, 5.0, 0),
                     (13, 50, 5.0, -1), (14, 60, 5.0, 1)])
    assert [r["pincodeNum"] for r in eligible_offers(o).collect()] == [14]


def test_null_document_value_not_eligible(spark, mk):
    o = _offers(mk, [(14, 60, 5.0, 1)])
    docs = to_documents(o).unionByName(
        spark.createDataFrame([(Z, 1, None)], "zone STRING, product BIGINT, "
                              "leastPrice STRUCT<pincodeNum: INT, buyingPrice: INT, "
                              "sellingPrice: DOUBLE, quantity: INT>"))
    flat = offers_from_documents(docs)
    assert flat.count() == 2
    assert [r["pincodeNum"] for r in eligible_offers(flat).collect()] == [14]


def test_tie_prefers_smaller_quantity(mk):
    o = _offers(mk, [(10, 100, 1.0, 5), (11, 100, 1.0, 2)])
    p = mk([(500, Z)], PIN_DDL)
    out = rows(min_price_for_zone(o, p))
    assert out == [(1, Z, 500, 138, 2)]


def test_tie_after_rounding_prefers_cheaper_buying_price(mk):
    # 100 at distance 2 -> 104.0 ; 101 at distance 1 -> 104.02 ; both round to 104
    o = _offers(mk, [(10, 100, 1.0, 7), (11, 101, 1.0, 9)])
    p = mk([(500, Z)], PIN_DDL)
    d = mk([(10, 500, 2.0), (11, 500, 1.0)], DIST_DDL)
    out = rows(min_price_for_zone(o, p, distances=d))
    assert out == [(1, Z, 500, 104, 7)]


def test_dearer_nearer_seller_wins(mk):
    o = _offers(mk, [(10, 90, 1.0, 1), (11, 120, 1.0, 2)])
    p = mk([(500, Z)], PIN_DDL)
    d = mk([(10, 500, 138.15), (11, 500, 68.4)], DIST_DDL)
    assert rows(min_price_for_zone(o, p, distances=d)) == [(1, Z, 500, 191, 2)]


def test_duplicate_pincode_rows_collapse(mk):
    o = _offers(mk, [(10, 100, 1.0, 1)])
    p = mk([(560079, Z), (560079, Z), (560080, "south ")], PIN_DDL)
    out = rows(min_price_for_zone(o, p))
    assert out == [(1, Z, 560079, 138, 1), (1, Z, 560080, 138, 1)]


def test_no_eligible_offer_no_row(mk):
    o = _offers(mk, [(10, 100, 1.0, 0), (11, 90, 1.0, 0)])
    p = mk([(500, Z)], PIN_DDL)
    assert min_price_for_zone(o, p).count() == 0


def test_unknown_product_no_row(spark, mk):
    o = _offers(mk, [(10, 100, 1.0, 1)])
    p = mk([(500, Z)], PIN_DDL)
    products = mk([(2,)], PROD_DDL)
    assert min_price_for_zone(o, p, products).count() == 0
    assert min_price_for_pin(spark, o, 1, Z, 500, products).count() == 0
    assert min_price_for_pin(spark, o, 1, Z, 500, mk([(1,)], PROD_DDL)).count() == 1


def test_source_equals_destination_is_free(mk):
    o = _offers(mk, [(504204, 100, 1.0, 1)])
    p = mk([(504204, Z)], PIN_DDL)
    d = mk([(504204, 504204, 50.0)], DIST_DDL)  # ignored: same pincode
    assert rows(min_price_for_zone(o, p, distances=d)) == [(1, Z, 504204, 102, 1)]


def test_missing_distance_zero_or_drop(mk):
    o = _offers(mk, [(10, 100, 1.0, 1), (11, 200, 1.0, 1)])
    p = mk([(500, Z)], PIN_DDL)
    d = mk([(11, 500, 1.0)], DIST_DDL)  # seller 10 has no entry
    assert rows(min_price_for_zone(o, p, distances=d, on_missing="zero")) == [(1, Z, 500, 102, 1)]
    assert rows(min_price_for_zone(o, p, distances=d, on_missing="drop")) == [(1, Z, 500, 205, 1)]


def test_single_pin_flat_charge(spark, mk):
    o = _offers(mk, [(10, 100, 1.0, 1), (11, 75, 1.0, 4)])
    out = min_price_for_pin(spark, o, 1, "south", 500).collect()
    assert [(r["pincode"], r["price"]) for r in out] == [(500, 94)]


def test_pins_batch_with_distances(mk):
    o = _offers(mk, [(10, 90, 1.0, 1), (11, 120, 1.0, 2)])
    req = mk([(1, "pin", 1, Z, 500), (2, "pin", 1, Z, 501), (3, "pin", 1, Z, 500)], REQ_DDL)
    d = mk([(10, 500, 138.15), (11, 500, 68.4), (10, 501, 0.5), (11, 501, 0.5)], DIST_DDL)
    out = rows(min_price_for_pins(o, req, distances=d))
    assert out == [(1, 1, Z, 500, 191), (2, 1, Z, 501, 92), (3, 1, Z, 500, 191)]


def test_stale_sort_regression_quote_is_true_minimum(mk):
    # selling prices 30, 10, 20 at distance 0: the quote is 10, not the first row
    o = _offers(mk, [(10, 1, 30.0, 1), (11, 1, 10.0, 1), (12, 1, 20.0, 1)])
    d = mk([(10, 500, 0.0), (11, 500, 0.0), (12, 500, 0.0)], DIST_DDL)
    dests = mk([(1, Z, 500)], "product BIGINT, zone STRING, pincode INT")
    out = rows(min_quote_for_pins(o, dests, d))
    assert out == [(1, Z, 500, "FALCON", 10.0)]


def test_each_destination_priced_independently(spark, mk):
    o = _offers(mk, [(10, 1, 100.0, 1), (11, 1, 100.0, 1), (12, 1, 100.0, 1)])
    d = mk([(10, 560079, 1.0), (11, 560079, 9.0), (12, 560079, 9.0),
            (10, 504204, 9.0), (11, 504204, 2.0), (12, 504204, 9.0),
            (10, 504296, 9.0), (11, 504296, 9.0), (12, 504296, 3.0)], DIST_DDL)
    dests = spark.createDataFrame([(1, Z, [560079, 504204, 504296])],
                                  "product BIGINT, zone STRING, dest_pins ARRAY<INT>")
    out = rows(min_quote_for_pins(o, dests, d))
    assert out == [(1, Z, 504204, "FALCON", 102.0), (1, Z, 504296, "FALCON", 103.0),
                   (1, Z, 560079, "FALCON", 101.0)]


def test_quote_drops_only_unmatched_seller(mk):
    o = _offers(mk, [(10, 1, 5.0, 1), (11, 1, 50.0, 1)])
    d = mk([(11, 500, 1.0)], DIST_DDL)
    dests = mk([(1, Z, 500)], "product BIGINT, zone STRING, pincode INT")
    assert rows(min_quote_for_pins(o, dests, d)) == [(1, Z, 500, "FALCON", 51.0)]


def test_argmin_and_top_k(mk):
    o = _offers(mk, [(10, 100, 1.0, 5), (11, 100, 1.0, 2), (12, 50, 1.0, 9), (13, 300, 1.0, 1)])
    a = rows(argmin_per_key(o).select("product", "finalPrice", "quantity", "pincodeNum"))
    assert a == [(1, 87, 9, 12)]
    t = top_k_offers(o, 3).orderBy("rank").collect()
    assert [(r["rank"], r["pincodeNum"]) for r in t] == [(1, 12), (2, 11), (3, 10)]


def test_zone_filter_single_zone(mk):
    o = mk([("NORTH", 1, 10, 100, 1.0, 1), ("SOUTH", 1, 11, 50, 1.0, 1)], OFFER_DDL)
    p = mk([(500, "NORTH"), (600, "SOUTH")], PIN_DDL)
    out = rows(min_price_for_zone(o, p, zone="north"))
    assert out == [(1, "NORTH", 500, 138, 1)]


def test_grid_fallback_matches_broadcast(mk):
    o = mk([(z, p, 10 + p % 3, 100 + p, 1.0, 1 + p % 2) for z in ("A", "B") for p in range(20)], OFFER_DDL)
    p = mk([(500 + i, "A" if i % 3 else "B") for i in range(12)], PIN_DDL)
    a = rows(min_price_for_zone(o, p))
    b = rows(min_price_for_zone(o, p, max_broadcast_rows=1))
    assert a == b and len(a) == 20 * 12
    d = mk([(10 + i % 3, 500 + j, float((i * j) % 7)) for i in range(3) for j in range(12)], DIST_DDL)
    c = rows(min_price_for_zone(o, p, distances=d))
    e = rows(min_price_for_zone(o, p, distances=d, max_broadcast_rows=1))
    f = rows(min_price_for_zone(o, p, distances=d, dest_bucket_rows=3))
    assert c == e == f


def test_nested_document_roundtrip(mk):
    o = _offers(mk, [(10, 100, 1.5, 1), (None, None, None, None)])
    docs = to_documents(o)
    assert docs.where(F.col("leastPrice").isNull()).count() == 1
    assert rows(offers_from_documents(docs)) == rows(o)


def test_min_price_core_over_attached_destinations(mk):
    from pinprice.plans.offers import attach_destination, min_price

    o = _offers(mk, [(10, 100, 1.0, 1), (11, 75, 1.0, 4), (12, 50, 1.0, 0)])
    req = mk([(1, "pin", 1, Z, 500), (2, "pin", 1, Z, 501)], REQ_DDL)
    out = rows(min_price(attach_destination(o, req), keys=("request_id", "destPin")))
    assert out == [(1, 500, 94), (2, 501, 94)]


def test_distance_mode_without_broadcasting_distances(mk):
    """Pruning and price agree when the distance table is too big to broadcast."""
    o = mk([(z, p, 10 + p % 4, 50 + (p * 7) % 30, 1.0, 1 + p % 3) for z in ("A", "B") for p in range(30)],
           OFFER_DDL)
    p = mk([(10 + i, "A" if i % 2 else "B") for i in range(8)], PIN_DDL)
    d = mk([(10 + i, 10 + j, float((i * 3 + j * 5) % 11)) for i in range(8) for j in range(8) if (i + j) % 5],
           DIST_DDL)
    for mode in ("zero", "drop"):
        small = rows(min_price_for_zone(o, p, distances=d, on_missing=mode))
        big = rows(min_price_for_zone(o, p, distances=d, on_missing=mode, max_broadcast_rows=20))
        assert small == big and len(small) > 0
