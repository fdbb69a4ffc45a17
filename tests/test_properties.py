"""Rewrites checked against brute force on random small inputs.

The brute force follows the definitions directly: every eligible offer is
priced at every destination of its zone and the least
(finalPrice, buyingPrice, quantity, pincodeNum) wins.
"""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import DIST_DDL, OFFER_DDL, PIN_DDL, REQ_DDL, rows
from pinprice.plans.offers import min_price_for_pins, min_price_for_zone, min_quote_for_pins

ZONES = ["N", "S"]
PINS = [1, 2, 3, 4, 5]

offer = st.tuples(st.sampled_from(ZONES), st.integers(1, 3), st.sampled_from(PINS + [9]),
                  st.one_of(st.none(), st.integers(1, 60)),
                  st.one_of(st.none(), st.sampled_from([1.0, 2.5, 7.25, 10.0])),
                  st.one_of(st.none(), st.integers(-1, 3)))
pin_row = st.tuples(st.sampled_from(PINS), st.sampled_from(ZONES))
dist_row = st.tuples(st.sampled_from(PINS + [9]), st.sampled_from(PINS),
                     st.sampled_from([0.0, 0.5, 1.0, 1.49, 2.0, 7.3, 20.0, None, math.nan]))

SETTINGS = settings(max_examples=12, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])


def price(b, c):
    return math.floor(b + 0.02 * b + c + 0.5)


def charges(src, dest, dist, on_missing):
    if src == dest:
        return [0.0]
    found = [d for (s, t, d) in dist if s == src and t == dest and d is not None and d == d]
    if found:
        return found
    return [0.0] if on_missing == "zero" else []


def brute_zone(offers, pins, dist, on_missing, flat):
    zp = {(z, p) for (p, z) in pins}
    best = {}
    for (z, prod, pn, b, _s, q) in offers:
        if b is None or q is None or q <= 0:
            continue
        for (zz, p) in zp:
            if zz != z:
                continue
            cs = [flat] if flat is not None else charges(pn, p, dist, on_missing)
            for c in cs:
                key = (price(b, c), b, q, pn)
                k = (prod, z, p)
                if k not in best or key < best[k]:
                    best[k] = key
    return sorted((k[0], k[1], k[2], v[0], v[2]) for k, v in best.items())


@SETTINGS
@given(st.lists(offer, max_size=14), st.lists(pin_row, min_size=1, max_size=7),
       st.lists(dist_row, max_size=20), st.sampled_from(["zero", "drop"]), st.sampled_from([1, 2]),
       st.sampled_from([0, 3, 2_000_000]))
def test_zone_distance_matches_brute_force(mk, offers, pins, dist, on_missing, bucket_rows, bound):
    """Whatever is broadcast (0: nothing), null distances included."""
    o, p, d = mk(offers, OFFER_DDL), mk(pins, PIN_DDL), mk(dist, DIST_DDL)
    got = rows(min_price_for_zone(o, p, distances=d, on_missing=on_missing, dest_bucket_rows=bucket_rows,
                                  max_broadcast_rows=bound))
    assert got == brute_zone(offers, pins, dist, on_missing, None)


def test_null_distance_is_no_entry(mk):
    offers = mk([("N", 1, 9, 100, None, 1), ("N", 1, 8, 101, None, 1)], OFFER_DDL)
    pins = mk([(1, "N"), (2, "N")], PIN_DDL)
    zero = mk([(9, 1, 50.0), (9, 2, None), (8, 1, 10.0), (8, 2, 10.0)], DIST_DDL)
    drop = mk([(9, 1, 0.0), (9, 2, None), (8, 1, 30.0), (8, 2, 30.0)], DIST_DDL)
    for bound in (0, 2_000_000):
        a = min_price_for_zone(offers, pins, distances=zero, max_broadcast_rows=bound)
        assert {r["pincode"]: r["finalPrice"] for r in a.collect()}[2] == 102
        b = min_price_for_zone(offers, pins, distances=drop, on_missing="drop", max_broadcast_rows=bound)
        assert {r["pincode"]: r["finalPrice"] for r in b.collect()}[2] == 133


@SETTINGS
@given(st.lists(offer, max_size=14), st.lists(pin_row, min_size=1, max_size=7))
def test_zone_flat_matches_brute_force(mk, offers, pins):
    o, p = mk(offers, OFFER_DDL), mk(pins, PIN_DDL)
    got = rows(min_price_for_zone(o, p, charge=35.99))
    assert got == brute_zone(offers, pins, [], "zero", 35.99)


@SETTINGS
@given(st.lists(offer, max_size=14), st.lists(dist_row, max_size=20),
       st.lists(st.tuples(st.integers(1, 3), st.sampled_from(ZONES), st.sampled_from(PINS)), min_size=1,
                max_size=5),
       st.sampled_from(["zero", "drop"]))
def test_pins_distance_matches_brute_force(mk, offers, dist, reqs, on_missing):
    o, d = mk(offers, OFFER_DDL), mk(dist, DIST_DDL)
    req = mk([(i, "pin", prod, z, p) for i, (prod, z, p) in enumerate(reqs)], REQ_DDL)
    got = rows(min_price_for_pins(o, req, distances=d, on_missing=on_missing))
    want = []
    for i, (prod, z, p) in enumerate(reqs):
        cands = [price(b, c) for (zz, pr, pn, b, _s, q) in offers
                 if zz == z and pr == prod and b is not None and q is not None and q > 0
                 for c in charges(pn, p, dist, on_missing)]
        if cands:
            want.append((i, prod, z, p, min(cands)))
    assert got == sorted(want)


@SETTINGS
@given(st.lists(offer, max_size=14), st.lists(dist_row, max_size=20),
       st.lists(st.tuples(st.integers(1, 3), st.sampled_from(ZONES), st.sampled_from(PINS)), min_size=1,
                max_size=5))
def test_quotes_match_brute_force(mk, offers, dist, dests):
    o, d = mk(offers, OFFER_DDL), mk(dist, DIST_DDL)
    dd = mk(dests, "product BIGINT, zone STRING, pincode INT")
    got = rows(min_quote_for_pins(o, dd, d))
    want = []
    for (prod, z, p) in sorted(set(dests)):
        cands = [s + c for (zz, pr, pn, _b, s, q) in offers
                 if zz == z and pr == prod and s is not None and q is not None and q > 0
                 for c in charges(pn, p, dist, "drop")]
        if cands:
            want.append((prod, z, p, "FALCON", min(cands)))
    assert got == sorted(want)


upd_row = st.tuples(st.integers(1, 3), st.integers(1, 3), st.one_of(st.none(), st.integers(0, 9)),
                    st.one_of(st.none(), st.integers(0, 3)))


@SETTINGS
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 3), st.integers(0, 9), st.integers(0, 3)),
                max_size=6, unique_by=lambda r: (r[0], r[1])),
       st.lists(st.lists(upd_row, max_size=5), min_size=1, max_size=3), st.randoms())
def test_sequenced_merge_any_order_and_replay(mk, spark, state, batches, rnd):
    from pinprice.sources.sinks import merge_values

    ddl = "product BIGINT, pincode INT, price BIGINT, quantity INT, request_id BIGINT"
    seq, dfs = 0, []
    for b in batches:
        rows_ = []
        for (p, pin, price, q) in b:
            seq += 1
            rows_.append((p, pin, price, q, seq))
        dfs.append(rows_)
    st0 = mk(state, "product BIGINT, pincode INT, price BIGINT, quantity INT")

    def run(order):
        cur = st0
        for i in order:
            cur = merge_values(cur, spark.createDataFrame(dfs[i], ddl), order_col="request_id")
        return rows(cur)

    forward = run(list(range(len(dfs))))
    shuffled = list(range(len(dfs)))
    rnd.shuffle(shuffled)
    assert run(shuffled + [shuffled[0]]) == forward
    want = {(p, pin): (price, q, None) for (p, pin, price, q) in state}
    for b in dfs:
        for (p, pin, price, q, s) in b:
            want[(p, pin)] = (price, q, s)   # later sequence numbers come later
    assert forward == sorted(((k[0], k[1]) + v for k, v in want.items()),
                             key=lambda t: tuple((x is None, x) for x in t))
