from pyspark.sql import functions as F

from conftest import OFFER_DDL, PIN_DDL, PROD_DDL, REQ_DDL, rows
from pinprice.operators.validate import validate_requests, zones_of
from pinprice.plans.offers import min_price_for_zone
from pinprice.plans.requests import price_requests


def test_bad_requests_rejected_with_reason(mk):
    p = mk([(500, "SOUTH"), (600, "NORTH")], PIN_DDL)
    req = mk([(1, "pin", None, "SOUTH", 500), (2, "pin", 1, None, 500), (3, "pin", 1, "NOWHERE", 500),
              (4, "pin", 1, "south", None), (5, "pin", 1, "South", 0), (6, "pin", 1, "SOUTH", -1),
              (7, "zone", 1, "north", None), (8, "pin", 1, " south ", 500), (9, "other", 1, "SOUTH", 500)],
             REQ_DDL)
    v = {r["request_id"]: (r["zone"], r["reject_reason"]) for r in validate_requests(req, zones_of(p)).collect()}
    assert v == {1: ("SOUTH", "null_product"), 2: (None, "null_zone"), 3: ("NOWHERE", "unknown_zone"),
                 4: ("SOUTH", "null_pincode"), 5: ("SOUTH", "bad_pincode"), 6: ("SOUTH", "bad_pincode"),
                 7: ("NORTH", None), 8: ("SOUTH", None), 9: ("SOUTH", "bad_kind")}


def _world(mk):
    o = mk([("SOUTH", 1, 500, 100, 1.0, 2), ("SOUTH", 1, 501, 75, 1.0, 3), ("NORTH", 1, 600, 10, 1.0, 1),
            ("NORTH", 2, 600, 20, 1.0, 1), ("SOUTH", 3, 500, 50, 1.0, 0)], OFFER_DDL)
    p = mk([(500, "SOUTH"), (501, "SOUTH"), (600, "NORTH")], PIN_DDL)
    return o, p


def test_price_requests_pin_and_zone(mk):
    o, p = _world(mk)
    req = mk([(1, "pin", 1, "south", 500), (2, "zone", 1, "SOUTH", None), (3, "pin", 3, "SOUTH", 500),
              (4, "pin", 9, "SOUTH", 500), (5, "pin", 1, "WEST", 500)], REQ_DDL)
    out = rows(price_requests(req, o, p, mk([(1,), (2,), (3,)], PROD_DDL)))
    assert out == [(1, "pin", 1, "SOUTH", 500, 94, None),
                   (2, "zone", 1, "SOUTH", 500, 112, 3), (2, "zone", 1, "SOUTH", 501, 112, 3)]


def test_full_zone_request_table_equals_zone_job(mk):
    o, p = _world(mk)
    req = mk([(i, "zone", prod, z, None) for i, (prod, z) in
              enumerate([(1, "SOUTH"), (1, "NORTH"), (2, "NORTH"), (2, "SOUTH"), (3, "SOUTH")])], REQ_DDL)
    a = price_requests(req, o, p).select("product", "zone", "pincode", "price", "quantity")
    b = min_price_for_zone(o, p).select("product", "zone", "pincode", F.col("finalPrice").alias("price"),
                                        "quantity")
    assert rows(a) == rows(b)


def test_distance_mode_requests(mk):
    o, p = _world(mk)
    d = mk([(500, 501, 10.0), (501, 500, 30.0), (501, 501, 99.0)], "sourcePincode INT, destPincode INT, "
                                                                   "distance DOUBLE")
    req = mk([(1, "pin", 1, "SOUTH", 500), (2, "zone", 1, "SOUTH", None)], REQ_DDL)
    out = rows(price_requests(req, o, p, distances=d))
    # pin 500: seller 500 free (102) vs seller 501 at 30 (107) -> 102
    # pin 501: seller 500 at 10 (112) vs seller 501 free (77) -> 77 with quantity 3
    assert out == [(1, "pin", 1, "SOUTH", 500, 102, None),
                   (2, "zone", 1, "SOUTH", 500, 102, 2), (2, "zone", 1, "SOUTH", 501, 77, 3)]
