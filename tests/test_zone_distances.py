"""Whole-zone prices with distances: every layout against brute force, and what each plan moves."""

import contextlib
import io
import math
import os
import random

import pytest
from conftest import DIST_DDL, OFFER_DDL, PIN_DDL, rows

from pinprice.plans.charges import charge_arrays
from pinprice.plans.offers import _in_chunks, _lists, _lists_in_chunks, min_price_for_zone, seller_winners
from pinprice.session import materialised, shared_dir


def data(rng, sellers=30, pins=25, products=3):
    zones = ["N", "S"]
    at = {p: {zones[p % 2]} | ({"N", "S"} if p % 7 == 0 else set()) for p in range(pins)}
    pincodes = [(p, z) for p, zs in at.items() for z in zs]
    offers = [(rng.choice(zones), rng.randrange(products), rng.randrange(sellers), rng.choice([None, *range(50, 60)]), 1.0,
               rng.choice([None, 0, 1, 2, 5])) for _ in range(400)]
    distances = [(s, d, rng.choice([None, math.nan, 0.0, 1.5, 7.25, 30.0])) for s in range(sellers) for d in range(pins)
                 if rng.random() < 0.6]
    distances += distances[:40] + [(s, s, 99.0) for s in range(5)]  # repeated pairs, distances to oneself
    return offers, pincodes, distances


def brute(offers, pincodes, distances, on_missing):
    near = {}
    for s, d, x in distances:
        if x is not None and not math.isnan(x):
            near.setdefault((s, d), []).append(x)
    best = {}
    for z, p, s, b, _, q in offers:
        if b is None or q is None or q <= 0:
            continue
        for pin, zone in pincodes:
            if zone != z:
                continue
            charges = [0.0] if s == pin else near.get((s, pin), [0.0] if on_missing == "zero" else [])
            for c in charges:
                row = (math.floor(b + 0.02 * b + c + 0.5), b, q, s)
                k = (p, z, pin)
                best[k] = min(best.get(k, row), row)
    return sorted((*k, r[0], r[2]) for k, r in best.items())


LAYOUTS = [dict(), dict(max_broadcast_rows=1), dict(max_broadcast_rows=0, dest_bucket_rows=4),
           dict(max_broadcast_rows=30, dest_bucket_rows=6, seller_chunk_rows=3), dict(seller_chunk_rows=2, dest_bucket_rows=5)]


@pytest.mark.parametrize("on_missing", ["zero", "drop"])
@pytest.mark.parametrize("layout", LAYOUTS)
def test_every_layout_equals_brute_force(mk, layout, on_missing):
    offers, pincodes, distances = data(random.Random(3))
    got = min_price_for_zone(mk(offers, OFFER_DDL), mk(pincodes, PIN_DDL), distances=mk(distances, DIST_DDL),
                             on_missing=on_missing, **layout)
    assert got.columns == ["product", "zone", "pincode", "finalPrice", "quantity"]
    assert rows(got) == brute(offers, pincodes, distances, on_missing)


def plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("simple")
    return buf.getvalue().split("\n")


def test_beyond_the_broadcast_bound_the_expansion_is_not_moved(mk):
    """With a bound of one row: from the array's expansion up to the least offer there is no exchange."""
    offers, pincodes, distances = data(random.Random(4))
    p = plan(min_price_for_zone(mk(offers, OFFER_DDL), mk(pincodes, PIN_DDL), distances=mk(distances, DIST_DDL),
                                max_broadcast_rows=1))
    for g in [i for i, line in enumerate(p) if "Generate inline" in line]:
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        above = [p[i] for i in range(g) if depth(p[i]) < depth(p[g]) and all(
            depth(p[i]) < depth(p[j]) for j in range(i + 1, g) if depth(p[j]) < depth(p[g]))]
        first = next(i for i in range(len(above) - 1, -1, -1) if "Exchange" in above[i] or i == 0)
        between = "".join(above[first + 1:])
        assert "partial_min(struct(finalPrice" in between and " min(struct(finalPrice" in between.replace("=[min", "=[ min")
    assert any("Generate inline" in line for line in p) and not any("BroadcastHashJoin" in line for line in p)


def test_charge_arrays_hold_every_destination_once(mk):
    offers, pincodes, distances = data(random.Random(5))
    pins = mk([(*x, 0) for x in sorted(set(pincodes))], PIN_DDL + ", _db INT")
    sellers = mk([(z, s, 0) for z in "NS" for s in range(30)], "zone STRING, pincodeNum INT, _db INT")
    for mode in ("zero", "drop"):
        for r in charge_arrays(sellers, pins, mk(distances, DIST_DDL), mode).collect():
            dests = {p for p, z in pincodes if z == r["zone"]}
            got = {e["pincode"]: e["charge"] for e in r["entries"]}
            assert len(got) == len(r["entries"]) and (got.keys() == dests) == r["full"]
            assert got.get(r["pincodeNum"], 0) == 0 and min(got.values()) == r["cmin"] and max(got.values()) == r["cmax"]
            assert mode == "drop" or got.keys() == dests


def test_a_product_of_many_sellers_is_dealt_by_chunks(mk, spark):
    """Half of all sellers sell one product: its rows lie in chunks of bounded size, and the prices are the same."""
    rng = random.Random(6)
    offers = [("N", 1, s, rng.randrange(100, 104), 1.0, 1) for s in range(500)] + [
        ("N", 2 + s % 50, s, 100, 1.0, 1) for s in range(500)]
    pincodes = [(p, "N") for p in range(1000, 1020)]
    distances = [(s, p, rng.randrange(400) / 4) for s in range(500) for p, _ in pincodes]
    o, p, d = mk(offers, OFFER_DDL), mk(pincodes, PIN_DDL), mk(distances, DIST_DDL)
    got = min_price_for_zone(o, p, distances=d, on_missing="drop", seller_chunk_rows=40)
    assert rows(got) == brute(offers, pincodes, distances, "drop")
    s = seller_winners(o).selectExpr("*", "0 AS _db").repartition("zone", "product", "_db")
    few, many = _in_chunks(s, 40)
    sizes = many.groupBy("product", "_sc").count().collect()
    assert {r["product"] for r in sizes} == {1} and len(sizes) == 13 and max(r["count"] for r in sizes) == 40
    assert few.where("product = 1").count() == 0 and few.count() + many.count() == s.count()


@pytest.mark.parametrize("layout", [dict(), dict(max_broadcast_rows=1)])
def test_the_least_offer_is_taken_inside_the_expanded_row(mk, layout):
    """Above the lists of sellers that meet their destinations nothing is sorted, aggregated or exchanged."""
    offers, pincodes, distances = data(random.Random(7))
    p = plan(min_price_for_zone(mk(offers, OFFER_DDL), mk(pincodes, PIN_DDL), distances=mk(distances, DIST_DDL), **layout))
    least = next(i for i, line in enumerate(p) if "array_min(transform(sellers" in line)
    assert not any(word in line for line in p[:least] for word in ("Sort", "Aggregate", "Exchange"))


def test_lists_of_many_sellers_are_dealt_by_chunks(mk):
    offers = [("N", 1, s, 100, 1.0, 1) for s in range(90)] + [("N", 2, s, 100, 1.0, 1) for s in range(40)]
    s = seller_winners(mk(offers, OFFER_DDL)).selectExpr("*", "0 AS _db", "pincodeNum AS _i")
    few, many = _lists_in_chunks(_lists(s), 40)
    assert [(r["product"], len(r["sellers"])) for r in few.collect()] == [(2, 40)]
    assert sorted((r["product"], r["_sc"], r["count"]) for r in many.groupBy("product", "_sc").count().collect()) == [
        (1, 0, 40), (1, 1, 40), (1, 2, 10)]
    assert sorted(r["pincodeNum"] for r in many.collect()) == list(range(90))


def test_beyond_the_broadcast_bound_steps_are_kept_as_columns(mk, spark):
    """Only the charges are checkpointed, as rows in memory are; the seller winners go when the lists are stored."""
    base = shared_dir(spark, unique=False).removeprefix("file:")
    kinds = ("zone-sellers", "zone-lists")

    def there():
        of = {k: len(os.listdir(f"{base}/{k}")) if os.path.isdir(f"{base}/{k}") else 0 for k in kinds}
        return of, sum(x.startswith("rdd-") for _, dirs, _ in os.walk(base) for x in dirs)

    offers, pincodes, distances = data(random.Random(8))
    (before, rdds), got = there(), min_price_for_zone(mk(offers, OFFER_DDL), mk(pincodes, PIN_DDL), distances=mk(distances, DIST_DDL),
                                                      max_broadcast_rows=1)
    assert rows(got) == brute(offers, pincodes, distances, "zero")
    after, rdds_after = there()
    assert [after[k] - before[k] for k in kinds] == [0, 1] and rdds_after == rdds + 1


def test_a_stored_step_keeps_no_shuffle_files(mk, spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    df = mk([(i, i % 7) for i in range(1000)], "a long, b long")
    assert sorted(r["n"] for r in materialised(df.groupBy("b").agg({"a": "count"}).toDF("b", "n"), "steps").collect()) == [142] + [143] * 6
    assert spark.conf.get(key, None) == before


@pytest.mark.parametrize("on_missing", ["zero", "drop"])
@pytest.mark.parametrize("layout", [dict(), dict(max_broadcast_rows=0, dest_bucket_rows=4)])
def test_lists_on_both_sides_of_the_slots_equal_brute_force(mk, layout, on_missing):
    """Lists shorter and longer than the compiled slots, with ties, in blocks of few destinations."""
    offers = [("N", p, s, 100 + (s % 2), 1.0, 1 + s % 3) for p in range(8) for s in range(p + 1)]
    pincodes = [(k, "N") for k in range(9)]
    distances = [(s, k, float((s * 5 + k * 3) % 7)) for s in range(8) for k in range(9) if (s + k) % 4]
    got = min_price_for_zone(mk(offers, OFFER_DDL), mk(pincodes, PIN_DDL), distances=mk(distances, DIST_DDL),
                             on_missing=on_missing, **layout)
    assert rows(got) == brute(offers, pincodes, distances, on_missing)


@pytest.mark.parametrize("layout", [dict(), dict(max_broadcast_rows=0)])
def test_short_lists_are_priced_by_compiled_expressions(mk, layout):
    """No function of arrays, which is interpreted seller by seller, lies above the walk of destinations of short lists."""
    offers, pincodes, distances = data(random.Random(9))
    p = plan(min_price_for_zone(mk(offers, OFFER_DDL), mk(pincodes, PIN_DDL), distances=mk(distances, DIST_DDL), **layout))
    price = next(i for i, line in enumerate(p) if "least(_p0" in line)
    walk = next(i for i in range(price, len(p)) if "Generate explode" in p[i])
    assert not any("transform(" in line for line in p[price:walk])
