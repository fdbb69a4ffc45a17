"""Quotes by threshold search, offers and key-value tables laid out for key matches, and SQL table functions."""

import contextlib
import io
import math
import random
import uuid

import pytest
from conftest import DIST_DDL, OFFER_DDL, PIN_DDL, PROD_DDL, rows, uniq

from pinprice.functions.tables import register_table_functions
from pinprice.operators.joins import task_count
from pinprice.plans.distances import export_distances
from pinprice.plans.jobs import recompute_quotes
from pinprice.plans.offers import (
    min_entry_for_pincodes,
    min_price_for_pin,
    min_price_for_zone,
    min_quote_for_pins,
    quote_candidates,
    quote_sellers,
)
from pinprice.session import shared_dir
from pinprice.sources.fixtures import pincodedistances, product_prices
from pinprice.sources.sinks import (
    lookup_keys,
    merge_into_table,
    merge_values,
    price_map,
    price_updates,
    replace_kv,
    write_bucketed,
)
from pinprice.sources.tables import fetch_by_id, read_offers, read_table, write_offers


def plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def scanned_rows(df):
    """Rows that the file scans hand on, after row groups were skipped (a plan without exchanges)."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.length()))


# -- quotes


def quotes(offers, dests, distances, on_missing):
    near = {}
    for s, d, x in distances:
        if x is not None and not math.isnan(x):
            near.setdefault((s, d), []).append(x)
    out = {}
    for p, z, pin in dests:
        for zone, product, s, _, price, q in offers:
            if (zone, product) != (z, p) or price is None or q is None or q <= 0:
                continue
            for c in [0.0] if s == pin else near.get((s, pin), [0.0] if on_missing == "zero" else []):
                out[p, z, pin] = min(out.get((p, z, pin), math.inf), price + c)
    return sorted((*k, "FALCON", v) for k, v in out.items())


def quote_data(rng):
    offers = [(rng.choice("NS"), rng.randrange(4), rng.randrange(25), 1, rng.choice([None, *map(float, range(40))]),
               rng.choice([None, 0, 1, 3])) for _ in range(300)]
    dests = sorted({(rng.randrange(5), rng.choice("NS"), rng.randrange(30)) for _ in range(120)})
    distances = [(s, d, rng.choice([None, math.nan, -2.0, 0.5, 3.0, 20.0])) for s in range(25) for d in range(30)
                 if rng.random() < 0.4]
    return offers, dests, distances + distances[:30]


@pytest.mark.parametrize("on_missing", ["drop", "zero"])
@pytest.mark.parametrize("options", [dict(), dict(first=1, max_broadcast_rows=0), dict(first=100, max_broadcast_rows=0),
                                     dict(first=2, max_broadcast_rows=1)])
def test_threshold_search_is_exact(mk, options, on_missing):
    offers, dests, distances = quote_data(random.Random(4))
    got = min_quote_for_pins(mk(offers, OFFER_DDL), mk(dests, "product BIGINT, zone STRING, pincode INT"),
                             mk(distances, DIST_DDL), on_missing=on_missing, **options)
    assert rows(got) == quotes(offers, dests, distances, on_missing)


def test_few_pairs_reach_the_distance_table(mk):
    """Sellers of rising price: a destination is looked up for the first ones and none that can't be cheaper."""
    offers = [("N", 1, s, 1, 10.0 * s, 1) for s in range(200)]
    dests = [(1, "N", 1000 + d) for d in range(50)]
    distances = [(s, p, 1.0 + (s + p) % 9) for s in range(200) for _, _, p in dests]
    o, d, x = mk(offers, OFFER_DDL), mk(dests, "product BIGINT, zone STRING, pincode INT"), mk(distances, DIST_DDL)
    sellers = quote_sellers(o, x)
    early = quote_candidates(d, sellers, None, 4)
    best = min_quote_for_pins(o, d, x).selectExpr("product", "zone", "pincode", "price AS bound")
    late = quote_candidates(d, sellers, best, 4)
    assert early.count() == 4 * 50 and late.count() == 0    # of 200 * 50 pairs


def test_quotes_keep_the_other_entries_whole(mk, spark):
    ddl = "product BIGINT, pincode INT, price DOUBLE, quantity INT, type STRING"
    state = spark.createDataFrame([(1, 10, 5.0, 7, None), (1, 11, 6.0, 8, "OLD"), (2, 10, 1.0, None, None)], ddl)
    offers = mk([("N", 1, 3, 1, 30.0, 2), ("N", 1, 4, 1, 20.0, 1)], OFFER_DDL)
    dests = mk([(1, "N", 11), (1, "N", 12), (9, "N", 11)], "product BIGINT, zone STRING, pincode INT")
    distances = mk([(3, 11, 1.0), (4, 11, 12.0), (4, 12, 2.5)], DIST_DDL)
    got = recompute_quotes(state, offers, dests, distances)
    assert rows(got) == [(1, 10, 5.0, 7, None), (1, 11, 31.0, None, "FALCON"), (1, 12, 22.5, None, "FALCON"),
                         (2, 10, 1.0, None, None)]


# -- offers


def test_a_product_is_found_without_reading_the_zone(mk, spark):
    rng = random.Random(1)
    rnd = [(z, rng.randrange(3000) if rng.random() < 0.7 else 77, rng.randrange(500), rng.randrange(10_000), 1.0, 1)
           for z in "ns" for _ in range(30_000)]
    path = shared_dir(spark, "test-clustered")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # partitions this small would be merged
    try:
        write_offers(mk(rnd, OFFER_DDL).repartition(6), path, options={"parquet.block.size": str(32 << 10)})
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    zone = sum(z == "n" for z, *_ in rnd)
    one = read_offers(spark, path, zone="N", product=1234)
    want = sorted((z.upper(), *r) for z, *r in rnd if z == "n" and r[0] == 1234)
    assert rows(one) == want and want
    assert scanned_rows(one) < zone / 5                        # row groups were skipped
    assert scanned_rows(read_offers(spark, path, zone="N", product=999_999)) == 0
    sizes = [r["n"] for r in spark.read.parquet(path).where("product = 77").selectExpr("input_file_name() AS f").groupBy(
        "f").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()]
    assert len(sizes) > 3                                       # a hot product lies in many files


def test_bloom_filters_rule_out_row_groups_that_span_a_product(mk, spark):
    """Even products only, in one row group: an odd one lies inside its extremes and is still not read."""
    path = shared_dir(spark, "test-bloom")
    write_offers(mk([("n", 2 * i, 1, 1, 1.0, 1) for i in range(2000)], OFFER_DDL).coalesce(1), path, products=2000)
    df = read_offers(spark, path, zone="n", product=1001)
    spark.conf.set("spark.sql.parquet.filterPushdown", "true")
    assert scanned_rows(df) == 0 and scanned_rows(read_offers(spark, path, zone="n", product=1000)) > 0


def test_a_single_request_reaches_the_scan(mk, spark):
    path = shared_dir(spark, "test-single")
    write_offers(mk([("n", p, 1, 100 + p, 1.0, 1) for p in range(50)] + [("s", 7, 1, 1, 1.0, 1)], OFFER_DDL), path)
    df = min_price_for_pin(spark, read_offers(spark, path), 7, " N", 5, mk([(p,) for p in range(50)], PROD_DDL))
    assert rows(df) == [(7, "N", 5, math.floor(107 + 0.02 * 107 + 17.09 + 0.5))]
    p = plan(df)
    assert "EqualTo(product,7)" in p and "(zone" in p.split("PartitionFilters")[1].split("\n")[0]


def test_read_options_of_one_read_win(spark, mk):
    path = shared_dir(spark, "test-options")
    mk([("a", 1, None, 5, 1.5, 2)], OFFER_DDL).write.option("sep", ";").option("nullValue", "?").csv(path, header=True)
    base = {"header": "true", "sep": ",", "nullValue": "?"}
    from pinprice import schemas

    got = read_table(spark, path, schemas.OFFERS, "csv", base, {"sep": ";"})
    assert rows(got) == [("a", 1, None, 5, 1.5, 2)] and got.schema == schemas.OFFERS


# -- key-value table


def test_replaced_table_is_read_by_bucket(mk, spark):
    d = [(s, t, float(s)) for s in range(40) for t in range(10)]
    path, name = shared_dir(spark, "test-kv-table"), uniq("t_kv")
    first = replace_kv(export_distances(mk(d[:20], DIST_DDL)), name, path, buckets=8)
    assert first.count() == 20
    kv = replace_kv(export_distances(mk(d, DIST_DDL)), name, path, buckets=8)
    assert kv.count() == 400 == spark.table(name).count()
    one = lookup_keys(spark, name, ["7_3", "no"])
    assert rows(one) == [("7_3", "7.0")]
    assert scanned_rows(lookup_keys(spark, name, ["7_3"])) < 100     # one bucket's file
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that the plan tells
    try:
        assert "SelectedBucketsCount: 2 out of 8" in plan(lookup_keys(spark, name, ["7_3", "no"]))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    keys = spark.createDataFrame([("1_1",), ("2_2",)], "src_dest STRING")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(kv.join(keys, "src_dest", "left_semi"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in p and p.count("Arguments: hashpartitioning(src_dest") == 1


def test_a_failed_replacement_leaves_the_table(mk, spark):
    path, name = shared_dir(spark, "test-kv-table"), uniq("t_kv")
    replace_kv(export_distances(mk([(1, 2, 3.0)], DIST_DDL)), name, path, buckets=2)
    with pytest.raises(ValueError):
        replace_kv(export_distances(mk([(1, 2, 3.5), (1, 2, 4.0)], DIST_DDL)), name, path, buckets=2)
    bad = export_distances(mk([(5, 6, 1.0)], DIST_DDL)).selectExpr("src_dest", "raise_error('stop') AS distance")
    with pytest.raises(Exception, match="stop"):
        replace_kv(bad, name, path, buckets=2, check_unique=False)
    assert rows(spark.table(name)) == [("1_2", "3.0")]


# -- SQL table functions


def test_table_functions_by_literals_and_lateral(mk, spark):
    offers = mk([("N", 1, 3, 100, 1.0, 5), ("N", 1, 4, 100, 1.0, 2), ("S", 1, 4, 90, 1.0, 1), ("N", 2, 3, None, 1.0, 9),
                 ("N", 8, 3, 5, 1.0, 9)], OFFER_DDL)
    pins = mk([(10, " n"), (10, "N"), (11, "N"), (12, "S"), (None, "N")], PIN_DDL)
    products, distances = mk([(1,), (2,)], PROD_DDL), mk([(3, 10, 4.5), (3, 10, 2.0), (4, 10, None)], DIST_DDL)
    pin, zone, dist = register_table_functions(spark, offers, pins, products, distances, prefix="t_")
    assert rows(spark.sql(f"SELECT * FROM {pin}(1, ' n ')")) == [(1, "N", 119)]
    assert rows(spark.sql(f"SELECT * FROM {pin}(8, 'N')")) == [] == rows(spark.sql(f"SELECT * FROM {pin}(2, 'N')"))
    assert rows(spark.sql(f"SELECT * FROM {zone}('n')")) == rows(min_price_for_zone(offers, pins, products, "n"))
    assert rows(spark.sql(f"SELECT * FROM {dist}(3, 10)")) == [("3_10", 2.0), ("3_10", 4.5)]
    mk([(1, "N"), (1, "S"), (1, None), (9, "N")], "product BIGINT, zone STRING").createOrReplaceTempView("t_keys")
    df = spark.sql(f"SELECT k.zone AS asked, f.* FROM t_keys k, LATERAL {pin}(k.product, k.zone) f")
    assert rows(df) == [("N", 1, "N", 119), ("S", 1, "S", 109)]
    assert not any(x in plan(df) for x in ("NestedLoop", "Cartesian", "EvalPython"))


def test_the_zone_function_expands_without_a_shuffle_by_zone(mk, spark):
    """The five zones would be five tasks: a zone's pincodes are broadcast, also where no plan would do so by itself."""
    import contextlib
    import io

    from conftest import DIST_DDL, OFFER_DDL, PIN_DDL, PROD_DDL, rows

    from pinprice.functions.tables import register_table_functions

    offers = mk([("N", 1, 5, 100, 1.0, 2), ("N", 2, 5, 50, 1.0, 1), ("S", 1, 6, 90, 1.0, 3)], OFFER_DDL)
    pins = mk([(10, "n "), (11, "N"), (11, "N"), (12, "S")], PIN_DDL)
    fn = register_table_functions(spark, offers, pins, mk([(1,), (2,)], PROD_DDL), mk([], DIST_DDL), prefix="t_zone_fn_")[1]
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        df = spark.sql(f"SELECT f.* FROM VALUES ('N'), ('S') z(zone), LATERAL {fn}(z.zone) f")
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain()
        assert "BroadcastHashJoin [zone" in buf.getvalue()
        assert rows(df) == [(1, "N", 10, 138, 2), (1, "N", 11, 138, 2), (1, "S", 12, 128, 3),
                            (2, "N", 10, 87, 1), (2, "N", 11, 87, 1)]
    finally:
        spark.conf.set(key, old)


def test_map_of_expanded_winners_is_folded_without_a_sort_of_the_expansion(spark):
    offers = spark.createDataFrame(
        [("ASIA", p, 1, 100 + p, 1.0, 2) for p in range(300)],
        "zone string, product long, pincodeNum int, buyingPrice int, sellingPrice double, quantity int")
    pins = spark.createDataFrame([(k, "ASIA") for k in range(20)], "pincode int, zone string")
    res = min_entry_for_pincodes(offers, pins, partitions=4)
    docs = price_map(price_updates(res, "price", unique=True))
    plan = docs._jdf.queryExecution().executedPlan().toString()
    # lists of the expansion are folded as they come; the collect_list there is no object hash aggregate
    assert not [x for x in plan.splitlines() if "ObjectHashAggregate" in x and "collect_list" in x]
    top = plan[plan.index("collect_list"):plan.index("BroadcastHashJoin")]
    assert "Sort [" not in top and "Exchange" not in top
    assert {r["product"]: len(r["prices"]) for r in docs.collect()} == dict.fromkeys(range(300), 20)


def test_dealt_merge_neither_sorts_nor_moves_the_updates(spark, tmp_path):
    name = f"state_{uuid.uuid4().hex[:8]}"
    state = spark.createDataFrame([(1, 1, 5, 1), (1, 9, 7, 1), (2, 1, 6, 1), (9, 1, 3, 1), (None, 1, 1, 1)],
                                  "product long, pincode int, price long, quantity int")
    write_bucketed(state, name, str(tmp_path / "a"), ("product",), 4)
    upd = spark.createDataFrame([(1, 1, 5, 1), (2, 1, 6, 2), (3, 1, 8, 1), (1, 2, 4, 1)],
                                "product long, pincode int, price long, quantity int").repartition(4, "product")
    merged = merge_values(spark.table(name), upd, unique=True, held=True)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("Exchange") == 1
    new, n = merge_into_table(spark, name, upd, name + "_b", str(tmp_path / "b"), buckets=4, unique=True, dealt=True)
    assert n == 3
    assert sorted(map(tuple, new.where("product is not null").collect())) == [
        (1, 1, 5, 1), (1, 2, 4, 1), (1, 9, 7, 1), (2, 1, 6, 2), (3, 1, 8, 1), (9, 1, 3, 1)]
    assert new.where("product is null").count() == 1


def test_rows_of_a_task_are_bounded(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert task_count(spark, 0) == least
    assert task_count(spark, 10 ** 9) == max(least, 2000)
    rows = spark.createDataFrame([(k % 5, k) for k in range(50)], "product long, quantity int")
    first = fetch_by_id(rows, rows.where("product < 3"), "product", ["quantity"])
    assert "REPARTITION_BY_NUM" in first._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, first.collect())) == [(0, 0), (1, 1), (2, 2)]


def test_sellers_are_dealt_into_a_stated_number_of_partitions(spark):
    offers = spark.createDataFrame([("ASIA", 1, 10, 5, 2.0, 1), ("ASIA", 1, 11, 5, 1.0, 1)],
                                   "zone string, product long, pincodeNum int, buyingPrice int, sellingPrice double, quantity int")
    dist = spark.createDataFrame([(10, 12, 1.0), (11, 12, 4.0)], "sourcePincode int, destPincode int, distance double")
    s = quote_sellers(offers, dist)
    assert "REPARTITION_BY_NUM" in s._jdf.queryExecution().executedPlan().toString()
    assert [(r["pincodeNum"], r["lo"]) for r in s.orderBy("place").collect()] == [(10, 3.0), (11, 5.0)]


def test_shipments_are_moved_by_order_into_a_stated_number_of_partitions(spark, tmp_path):
    one = {"customer": ("c_custkey long, c_nationkey int", (1, 0)), "supplier": ("s_suppkey long, s_nationkey int", (2, 0)),
           "orders": ("o_orderkey long, o_custkey long", (3, 1)),
           "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double",
                        (3, 4, 2, 250.0, 6.0))}
    for name, (ddl, row) in one.items():
        spark.createDataFrame([row, row] if name == "lineitem" else [row], ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    state, pairs = product_prices(spark, str(tmp_path)), pincodedistances(spark, str(tmp_path))
    for df in (state, pairs):
        assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in state.collect()] == [(4, 500001, 2, 6)]
    assert [tuple(r)[:2] for r in pairs.collect()] == [(500002, 500001)]
