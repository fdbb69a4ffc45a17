"""

Every query runs over the whole stand-in tables derived from the driver's
Parquet files (``pinprice.sources.fixtures``); none is restricted to an id
subset or capped, except where the limit or a literal is the feature: ``q15``
(top 3 offers per product), ``q27`` (the capped export, first 10 keys), ``q30``
(one zone's offers) and ``q31`` (one request). The
oracle SQL is written in the direct form (every eligible offer against every
destination) so it checks the eager-aggregation rewrites of the library
rather than repeating them.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pinprice.functions.expr import PIN_CHARGE, ZONE_CHARGE, dist_key  # noqa: E402
from pinprice.operators.validate import (  # noqa: E402
    valid_requests,
    validate_requests,
    zones_of,
)
from pinprice.plans.charges import attach_charge  # noqa: E402
from pinprice.plans.distances import export_distances, lookup_distance  # noqa: E402
from pinprice.plans.offers import (  # noqa: E402
    argmin_per_key,
    attach_destination,
    eligible_offers,
    min_entry_for_pincodes,
    min_price,
    min_price_for_pin,
    min_price_for_pins,
    min_price_for_zone,
    min_quote_for_pins,
    price_for_destinations,
    price_offers,
    priceable_keys,
    store_zone_winners,
    top_k_offers,
)
from pinprice import schemas  # noqa: E402
from pinprice.functions.sql import register_sql_functions  # noqa: E402
from pinprice.functions.tables import register_table_functions  # noqa: E402
from pinprice.plans.jobs import recompute_prices, recompute_quotes, recompute_zone_prices  # noqa: E402
from pinprice.plans.requests import price_requests  # noqa: E402
from pinprice.session import co_located_joins, shared_dir  # noqa: E402
from pinprice.sources.fixtures import (  # noqa: E402
    fixture_cte,
    fixture_state_table,
    fixture_tables,
    state_buckets,
)
from pinprice.sources.sinks import (  # noqa: E402
    changed_count,
    merge_parts,
    merge_values,
    modified_products,
    price_map,
    price_updates,
    read_kv,
    read_parts,
    replace_kv,
    write_kv,
    write_parts,
)
from pinprice.sources.tables import (  # noqa: E402
    fetch_by_id,
    match,
    offers_from_documents,
    read_offers,
    read_table,
    to_documents,
    write_offers,
)
from pinprice.streaming.requests import (  # noqa: E402
    current_prices,
    read_stream_results,
    read_updates,
    stream_merge_prices,
    stream_price_requests,
)

SMOKE_DIR = "/root/testdata/sf0.001"
OFFER_COLS = ["zone", "product", "pincodeNum", "buyingPrice", "sellingPrice", "quantity"]


def _t(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return fixture_tables(spark, sf_dir)


def _valid(t: dict[str, DataFrame]) -> DataFrame:
    return valid_requests(validate_requests(t["requests"], zones_of(t["pincodes"])))


def _pin_requests(t: dict[str, DataFrame]) -> DataFrame:
    return _valid(t).where(F.col("kind") == "pin")


# --------------------------------------------------------------------------
# queries


def q01_zone_product_offers(spark, sf_dir):
    """Offers of every requested (zone, product): the per-request source match, set-based."""
    t = _t(spark, sf_dir)
    keys = _valid(t).select("zone", "product").distinct()
    return t["zoneprices"].join(keys, ["zone", "product"], "left_semi").select(*OFFER_COLS)


def q02_fetch_by_id(spark, sf_dir):
    """First offer (in a total order) of every requested product."""
    t = _t(spark, sf_dir)
    first = fetch_by_id(t["zoneprices"], _valid(t), "product",
                        ["zone", "pincodeNum", "buyingPrice", "sellingPrice", "quantity"], limit=1)
    return first.select(*OFFER_COLS)


def q03_known_products(spark, sf_dir):
    """Requested (zone, product) pairs that exist in the catalogue and have offers in the zone."""
    t = _t(spark, sf_dir)
    return priceable_keys(_valid(t), t["zoneprices"], t["productinfos"])


def q04_eligible_offers(spark, sf_dir):
    t = _t(spark, sf_dir)
    return eligible_offers(t["zoneprices"]).select(*OFFER_COLS)


def q05_nested_projection(spark, sf_dir):
    """Eligible offers read through the document form (nested struct fields)."""
    t = _t(spark, sf_dir)
    docs = to_documents(t["zoneprices"])
    docs = docs.where(F.col("leastPrice.buyingPrice").isNotNull() & (F.col("leastPrice.quantity") > 0))
    return offers_from_documents(docs).select(*OFFER_COLS)


def q06_price_flat(spark, sf_dir):
    t = _t(spark, sf_dir)
    return price_offers(t["zoneprices"], PIN_CHARGE).select(
        "zone", "product", "pincodeNum", "buyingPrice", "quantity", "finalPrice")


def q07_price_distance(spark, sf_dir):
    t = _t(spark, sf_dir)
    return price_for_destinations(t["zoneprices"], _pin_requests(t), t["pincodedistances"], "zero")


def q08_quote_selling(spark, sf_dir):
    """Every in-stock offer with a selling price, quoted at sellingPrice + distance."""
    t = _t(spark, sf_dir)
    x = attach_destination(eligible_offers(t["zoneprices"], "selling"), _pin_requests(t))
    x = attach_charge(x, t["pincodedistances"], "pincodeNum", "destPin", "drop")
    return x.select("request_id", "product", "pincodeNum", F.col("destPin").alias("destPincode"),
                    (F.col("sellingPrice") + F.col("charge")).alias("price"))


def q09_attach_destination(spark, sf_dir):
    t = _t(spark, sf_dir)
    x = attach_destination(t["zoneprices"], _pin_requests(t))
    return x.select("request_id", "destPin", *OFFER_COLS)


def q10_min_for_pin(spark, sf_dir):
    t = _t(spark, sf_dir)
    return min_price_for_pins(t["zoneprices"], _pin_requests(t), t["productinfos"], PIN_CHARGE)


def q11_min_for_zone_flat(spark, sf_dir):
    t = _t(spark, sf_dir)
    return min_price_for_zone(t["zoneprices"], t["pincodes"], t["productinfos"], charge=ZONE_CHARGE)


def q12_min_for_zone_distance(spark, sf_dir):
    t = _t(spark, sf_dir)
    return min_price_for_zone(t["zoneprices"], t["pincodes"], t["productinfos"],
                              charge=ZONE_CHARGE, distances=t["pincodedistances"], on_missing="zero")


def q13_min_quote_for_pins(spark, sf_dir):
    t = _t(spark, sf_dir)
    dests = _pin_requests(t).select("product", "zone", F.col("dest_pin").alias("pincode"))
    return min_quote_for_pins(t["zoneprices"], dests, t["pincodedistances"], t["productinfos"])


def q14_argmin_per_key(spark, sf_dir):
    t = _t(spark, sf_dir)
    return argmin_per_key(t["zoneprices"], ZONE_CHARGE, t["productinfos"])


def q15_top_k_offers(spark, sf_dir):
    t = _t(spark, sf_dir)
    return top_k_offers(t["zoneprices"], 3, ZONE_CHARGE).withColumnRenamed("rank", "offer_rank")


def q16_distance_kv(spark, sf_dir):
    t = _t(spark, sf_dir)
    return export_distances(t["pincodedistances"])


def q17_distance_lookup(spark, sf_dir):
    """Distances of every seller->destination pair of the pin requests."""
    t = _t(spark, sf_dir)
    # distinct sellers and destinations of a product first, so pairs are not multiplied by offers and requests
    sellers = t["zoneprices"].select("zone", "product", "pincodeNum").distinct()
    dests = _pin_requests(t).select("zone", "product", "dest_pin").distinct()
    x = dests.join(sellers, ["zone", "product"])
    keys = x.select(dist_key("pincodeNum", "dest_pin").alias("src_dest"))
    return lookup_distance(t["pincodedistances"], keys)


def _zone_entries(spark, t):
    """The entry of every product and pincode, those of one price and quantity as a group, dealt by product."""
    co_located_joins(spark)
    return min_entry_for_pincodes(t["zoneprices"], t["pincodes"], t["productinfos"], charge=ZONE_CHARGE,
                                  partitions=state_buckets(spark), grouped=True)


def _zone_updates(spark, t):
    """Every (product, pincode) once, dealt by product like the stored state."""
    return price_updates(_zone_entries(spark, t), "price", unique=True)


def q18_price_updates(spark, sf_dir):
    t = _t(spark, sf_dir)
    return _zone_updates(spark, t)


def q19_merged_prices(spark, sf_dir):
    """Zone prices merged into the price state (the updates are already limited
    to catalogue products by the price step, so the merge needs no second filter)."""
    t = _t(spark, sf_dir)
    return merge_values(t["product_prices"], _zone_updates(spark, t), unique=True)


def q20_changed_products(spark, sf_dir):
    t = _t(spark, sf_dir)
    return changed_count(t["product_prices"], _zone_updates(spark, t), unique=True)


def q21_validated_requests(spark, sf_dir):
    t = _t(spark, sf_dir)
    return validate_requests(t["requests"], zones_of(t["pincodes"])).select(
        "request_id", "kind", "product", "zone", "dest_pin", "reject_reason")


def q22_min_for_requests(spark, sf_dir):
    t = _t(spark, sf_dir)
    return price_requests(t["requests"], t["zoneprices"], t["pincodes"], t["productinfos"])


def q23_kv_overwrite_roundtrip(spark, sf_dir):
    """Export the distance table, overwrite a key-value table with it, read it back."""
    t = _t(spark, sf_dir)
    path = shared_dir(spark, "kv", "distance")
    write_kv(export_distances(t["pincodedistances"]), path)
    write_kv(export_distances(t["pincodedistances"]), path)  # a second overwrite replaces, not appends
    return read_kv(spark, path)


def _stored_winners(spark, t, base):
    """Winners aggregated once for a stream of request batches."""
    name = "pinprice_winners_" + base.rstrip("/").rsplit("/", 1)[-1][:12]
    return store_zone_winners(t["zoneprices"], name, f"{base}/winners", t["productinfos"],
                              buckets=state_buckets(spark))


def q24_stream_requests(spark, sf_dir):
    """Requests arrive as files; each micro-batch is priced against winners
    aggregated once (a stored table) and written idempotently."""
    t = _t(spark, sf_dir)
    base = shared_dir(spark, "stream")
    src, out, ckpt = (f"{base}/{p}" for p in ("requests", "out", "checkpoint"))
    t["requests"].repartitionByRange(4, "request_id").write.parquet(src)
    winners = _stored_winners(spark, t, base)
    q = stream_price_requests(spark, src, out, ckpt, t["zoneprices"], t["pincodes"], t["productinfos"],
                              max_files_per_trigger=2, winners=winners)
    q.awaitTermination()
    return read_stream_results(spark, out)


def q25_stream_merge_prices(spark, sf_dir):
    """Requests arrive as files; each micro-batch is priced against winners
    aggregated once and written as updates of the price state, which is read with
    them (newest request wins per key, in any batch order)."""
    t = _t(spark, sf_dir)
    base = shared_dir(spark, "stream-merge")
    src = f"{base}/requests"
    t["requests"].repartitionByRange(4, "request_id").write.parquet(src)
    updates = f"{base}/updates"
    q = stream_merge_prices(spark, src, updates, f"{base}/checkpoint", t["zoneprices"], t["pincodes"],
                            t["productinfos"], max_files_per_trigger=2, winners=_stored_winners(spark, t, base))
    q.awaitTermination()
    return current_prices(t["product_prices"], read_updates(spark, updates)).drop("seq")


def q26_min_for_requests_distance(spark, sf_dir):
    """The request table priced with the seller->destination distance charge."""
    t = _t(spark, sf_dir)
    return price_requests(t["requests"], t["zoneprices"], t["pincodes"], t["productinfos"],
                          distances=t["pincodedistances"], on_missing="zero")


def q27_distance_kv_first10(spark, sf_dir):
    """The capped export: the first 10 key-value rows in key order (the cap is the feature)."""
    t = _t(spark, sf_dir)
    return export_distances(t["pincodedistances"], limit=10)


def q28_recompute_changed(spark, sf_dir):
    """End-to-end batch job: validate and price the request table, merge into the
    price state as a new version, and count the products whose prices changed."""
    t = _t(spark, sf_dir)
    base = shared_dir(spark, "recompute")
    name = "pinprice_recompute_" + base.rstrip("/").rsplit("/", 1)[-1][:12]
    _, n = recompute_prices(spark, t["requests"], t["zoneprices"], t["pincodes"],
                            fixture_state_table(spark, sf_dir), name, f"{base}/state",
                            t["productinfos"], buckets=state_buckets(spark))
    return n


def q29_merged_quotes(spark, sf_dir):
    """Quotes of all requested destinations written over the stored entries of the price state."""
    t = _t(spark, sf_dir)
    dests = _pin_requests(t).select("product", "zone", F.col("dest_pin").alias("pincode"))
    state = t["product_prices"].select("product", "pincode", F.col("price").cast("double").alias("price"), "quantity",
                                       F.lit("STORED").alias("type"))
    return recompute_quotes(state, t["zoneprices"], dests, t["pincodedistances"], t["productinfos"])


def q30_one_zone_match(spark, sf_dir):
    """One zone's offers of one quantity, by literals: reads that zone's folder only."""
    t = _t(spark, sf_dir)
    path = shared_dir(spark, "zone-offers")
    write_offers(t["zoneprices"], path)
    return match(read_offers(spark, path, zone="asia"), quantity=10).select(*OFFER_COLS)


def q31_single_request(spark, sf_dir):
    """One literal request: the least delivered price of product 1 at one pincode of a zone."""
    t = _t(spark, sf_dir)
    return min_price_for_pin(spark, t["zoneprices"], 1, " asia", 500001, t["productinfos"])


def q32_min_price_core(spark, sf_dir):
    """Least price per request over offers that carry their destination."""
    t = _t(spark, sf_dir)
    return min_price(attach_destination(t["zoneprices"], _pin_requests(t)), keys=("request_id", "destPin"))


def q33_price_map_entries(spark, sf_dir):
    """The change set as one map per product, flattened back to its entries."""
    t = _t(spark, sf_dir)
    docs = price_map(price_updates(_zone_entries(spark, t), "price", unique=True, grouped=True))
    return docs.select("product", F.explode("prices").alias("pincode", "v")).select(
        "product", "pincode", "v.price", "v.quantity")


def q34_sql_functions(spark, sf_dir):
    """The price rules called by their registered SQL names."""
    t = _t(spark, sf_dir)
    names = register_sql_functions(spark)
    return eligible_offers(t["zoneprices"]).select(
        *OFFER_COLS, F.expr(f"{names[1]}(buyingPrice, {PIN_CHARGE}D)").alias("finalPrice"),
        F.expr(f"{names[0]}(sellingPrice)").alias("roundedSelling"))


def q35_string_keys(spark, sf_dir):
    """Requests priced with text product keys throughout."""
    t = _t(spark, sf_dir)
    text = lambda df: df.withColumn("product", F.concat(F.lit("p-"), F.col("product").cast("string")))
    return price_requests(text(t["requests"]), text(t["zoneprices"]), t["pincodes"], text(t["productinfos"]))


def q36_merge_touched_parts(spark, sf_dir):
    """The priced request table merged into a state stored by hash parts: only parts with an update are rewritten."""
    t = _t(spark, sf_dir)
    base = shared_dir(spark, "parts")
    state = t["product_prices"].withColumn("seq", F.lit(None).cast("bigint"))
    write_parts(state, f"{base}/state", parts=4 * state_buckets(spark))
    res = price_requests(t["requests"], t["zoneprices"], t["pincodes"], t["productinfos"])
    res.select("product", "pincode", "price", "quantity", F.col("request_id").alias("seq")).write.parquet(f"{base}/updates")
    merge_parts(spark, f"{base}/state", spark.read.parquet(f"{base}/updates"), order_col="seq")
    return read_parts(spark, f"{base}/state").drop("seq")


def q37_modified_per_product(spark, sf_dir):
    """Per product: entries that the priced request table writes, and how many of them change."""
    t = _t(spark, sf_dir)
    res = price_requests(t["requests"], t["zoneprices"], t["pincodes"], t["productinfos"])
    return modified_products(t["product_prices"], res, order_col="request_id")


def q38_recompute_zone_version(spark, sf_dir):
    """End to end for all products and pincodes: priced, merged into a new version of the state, read back."""
    t = _t(spark, sf_dir)
    base = shared_dir(spark, "zone-version")
    name = "pinprice_zones_" + base.rstrip("/").rsplit("/", 1)[-1][:12]
    new, _ = recompute_zone_prices(spark, t["zoneprices"], t["pincodes"], fixture_state_table(spark, sf_dir), name,
                                   f"{base}/state", t["productinfos"], buckets=state_buckets(spark))
    return new


def q39_read_options(spark, sf_dir):
    """Offers kept as delimited text, read by the store's options and this read's own, which win."""
    t = _t(spark, sf_dir)
    path = shared_dir(spark, "text-offers")
    t["zoneprices"].select(*OFFER_COLS).write.option("sep", "|").option("nullValue", "-").csv(path, header=True)
    store = {"header": "true", "sep": ",", "nullValue": "-"}
    offers = read_table(spark, path, schema=schemas.OFFERS, fmt="csv", options=store, overrides={"sep": "|"})
    return eligible_offers(offers).select(*OFFER_COLS)


def q40_kv_keyed_lookup(spark, sf_dir):
    """The distance export replaced twice in a table stored by key, and looked up there for every request's sellers."""
    t = _t(spark, sf_dir)
    base = shared_dir(spark, "kv-table")
    name = "pinprice_kv_" + base.rstrip("/").rsplit("/", 1)[-1][:12]
    replace_kv(export_distances(t["pincodedistances"].limit(0)), name, base, buckets=state_buckets(spark))
    kv = replace_kv(export_distances(t["pincodedistances"]), name, base, buckets=state_buckets(spark))
    sellers = t["zoneprices"].select("zone", "product", "pincodeNum").distinct()
    dests = _pin_requests(t).select("zone", "product", "dest_pin").distinct()
    keys = dests.join(sellers, ["zone", "product"]).select(dist_key("pincodeNum", "dest_pin").alias("src_dest"))
    found = kv.join(keys.where("src_dest is not null").distinct(), "src_dest", "left_semi")
    return found.select("src_dest", F.col("distance").cast("double").alias("distance"))


def _sql_tables(spark, t):
    return register_table_functions(spark, t["zoneprices"], t["pincodes"], t["productinfos"], t["pincodedistances"])


def q41_sql_pin_prices(spark, sf_dir):
    """Every pin request priced by the SQL table function."""
    t = _t(spark, sf_dir)
    fn = _sql_tables(spark, t)[0]
    _pin_requests(t).createOrReplaceTempView("pinprice_pin_requests")
    return spark.sql(f"""SELECT r.request_id, f.product, f.zone, r.dest_pin AS pincode, f.price
                         FROM pinprice_pin_requests r, LATERAL {fn}(r.product, r.zone) f""")


def q42_sql_zone_prices(spark, sf_dir):
    """Every zone's prices by the SQL table function."""
    t = _t(spark, sf_dir)
    fn = _sql_tables(spark, t)[1]
    zones_of(t["pincodes"]).createOrReplaceTempView("pinprice_zones")
    return spark.sql(f"SELECT f.* FROM pinprice_zones z, LATERAL {fn}(z.zone) f")


def q43_sql_distances(spark, sf_dir):
    """Distances of every seller->destination pair of the pin requests, by the SQL table function."""
    t = _t(spark, sf_dir)
    fn = _sql_tables(spark, t)[2]
    sellers = t["zoneprices"].select("zone", "product", "pincodeNum").distinct()
    dests = _pin_requests(t).select("zone", "product", "dest_pin").distinct()
    pairs = dests.join(sellers, ["zone", "product"]).select(F.col("pincodeNum").alias("src"), F.col("dest_pin").alias("dest"))
    pairs.distinct().createOrReplaceTempView("pinprice_pairs")
    return spark.sql(f"SELECT f.src_dest, f.distance FROM pinprice_pairs p, LATERAL {fn}(p.src, p.dest) f")


def q44_quotes_by_threshold(spark, sf_dir):
    """The quotes of q13 with a distance table that may not be broadcast: by threshold search."""
    t = _t(spark, sf_dir)
    dests = _pin_requests(t).select("product", "zone", F.col("dest_pin").alias("pincode"))
    return min_quote_for_pins(t["zoneprices"], dests, t["pincodedistances"], t["productinfos"], max_broadcast_rows=0)


def q45_zone_prices_by_arrays(spark, sf_dir):
    """The prices of q12 with tables that may not be broadcast: charges as arrays per seller pincode."""
    t = _t(spark, sf_dir)
    return min_price_for_zone(t["zoneprices"], t["pincodes"], t["productinfos"], distances=t["pincodedistances"],
                              on_missing="zero", max_broadcast_rows=0, seller_chunk_rows=100)


_QUERIES = [
    q01_zone_product_offers, q02_fetch_by_id, q03_known_products, q04_eligible_offers,
    q05_nested_projection, q06_price_flat, q07_price_distance, q08_quote_selling,
    q09_attach_destination, q10_min_for_pin, q11_min_for_zone_flat, q12_min_for_zone_distance,
    q13_min_quote_for_pins, q14_argmin_per_key, q15_top_k_offers, q16_distance_kv,
    q17_distance_lookup, q18_price_updates, q19_merged_prices, q20_changed_products,
    q21_validated_requests, q22_min_for_requests, q23_kv_overwrite_roundtrip, q24_stream_requests,
    q25_stream_merge_prices, q26_min_for_requests_distance, q27_distance_kv_first10,
    q28_recompute_changed, q29_merged_quotes, q30_one_zone_match, q31_single_request, q32_min_price_core,
    q33_price_map_entries, q34_sql_functions, q35_string_keys, q36_merge_touched_parts, q37_modified_per_product,
    q38_recompute_zone_version, q39_read_options, q40_kv_keyed_lookup, q41_sql_pin_prices, q42_sql_zone_prices,
    q43_sql_distances, q44_quotes_by_threshold, q45_zone_prices_by_arrays,
]


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: least delivered price for every product x zone x pincode (sf0.001)."""
    return q11_min_for_zone_flat(spark, SMOKE_DIR)


def _llm():
    """The training-data queries and their SQL; empty where the subpackage or the pipeline file is absent."""
    found, sql = {}, {}
    try:
        from pinprice.llm.queries import ORACLE, QUERIES
    except ModuleNotFoundError as e:
        if e.name not in ("pinprice.llm", "pinprice.llm.queries"):
            raise
        return found, sql
    found.update(QUERIES)
    sql.update(ORACLE)
    try:
        import corpus_pipeline
    except ModuleNotFoundError as e:
        if e.name != "corpus_pipeline":
            raise
        return found, sql
    found["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES} | _llm()[0]


# --------------------------------------------------------------------------


def _price(b: str, charge: str) -> str:
    bd = f"CAST({b} AS DOUBLE)"
    return (f"CAST(FLOOR({bd} + CAST(0.02 AS DOUBLE) * {bd} + {charge} "
            f"+ CAST(0.5 AS DOUBLE)) AS BIGINT)")


def _dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


_ZERO = "CAST(0 AS DOUBLE)"

_CHARGE_SQL = (f"CASE WHEN o.pincodeNum = {{dest}} THEN {_ZERO} "
               f"ELSE COALESCE(d.distance, {_ZERO}) END")

_EXTRA_CTE = f""",
zp AS (SELECT DISTINCT UPPER(TRIM(zone)) AS zone, pincode FROM pincodes
       WHERE zone IS NOT NULL AND pincode IS NOT NULL),
dist AS (SELECT * FROM pincodedistances WHERE distance IS NOT NULL AND NOT isnan(distance)),
zones AS (SELECT DISTINCT UPPER(TRIM(zone)) AS zone FROM pincodes WHERE zone IS NOT NULL),
vr AS (
  SELECT r.request_id, r.kind, r.product, UPPER(TRIM(r.zone)) AS zone, r.dest_pin,
    CASE WHEN r.product IS NULL THEN 'null_product'
         WHEN r.kind IS NULL OR r.kind NOT IN ('pin', 'zone') THEN 'bad_kind'
         WHEN r.zone IS NULL THEN 'null_zone'
         WHEN z.zone IS NULL THEN 'unknown_zone'
         WHEN r.kind = 'pin' AND r.dest_pin IS NULL THEN 'null_pincode'
         WHEN r.kind = 'pin' AND r.dest_pin <= 0 THEN 'bad_pincode' END AS reject_reason
  FROM requests r LEFT JOIN zones z ON UPPER(TRIM(r.zone)) = z.zone),
vreq AS (SELECT request_id, kind, product, zone, dest_pin FROM vr WHERE reject_reason IS NULL),
preq AS (SELECT * FROM vreq WHERE kind = 'pin'),
elig AS (SELECT * FROM zoneprices WHERE buyingPrice IS NOT NULL AND quantity > 0),
zw AS (
  SELECT zone, product, buyingPrice, quantity, pincodeNum FROM (
    SELECT zone, product, buyingPrice, quantity, pincodeNum,
      ROW_NUMBER() OVER (PARTITION BY zone, product ORDER BY {_price('buyingPrice', _dbl(ZONE_CHARGE))},
        buyingPrice, quantity, pincodeNum NULLS FIRST) AS rn
    FROM elig WHERE product IN (SELECT product FROM productinfos)) t WHERE rn = 1),
zone_flat AS (
  SELECT product, zone, pincode, finalPrice, quantity FROM (
    SELECT o.product, o.zone, p.pincode, o.buyingPrice, o.quantity, o.pincodeNum,
      {_price('o.buyingPrice', _dbl(ZONE_CHARGE))} AS finalPrice,
      ROW_NUMBER() OVER (PARTITION BY o.product, o.zone, p.pincode
        ORDER BY {_price('o.buyingPrice', _dbl(ZONE_CHARGE))}, o.buyingPrice, o.quantity,
                 o.pincodeNum NULLS FIRST) AS rn
    FROM elig o JOIN zp p ON p.zone = o.zone
    WHERE o.product IN (SELECT product FROM productinfos)) t WHERE rn = 1),
upd AS (
  SELECT product, pincode, price, quantity FROM (
    SELECT product, pincode, finalPrice AS price, quantity, ROW_NUMBER() OVER (PARTITION BY product, pincode
      ORDER BY finalPrice, quantity NULLS FIRST) AS rn
    FROM zone_flat) t WHERE rn = 1),
pin_flat AS (
  SELECT v.request_id, v.product, v.zone, v.dest_pin AS pincode,
    MIN({_price('o.buyingPrice', _dbl(PIN_CHARGE))}) AS price
  FROM preq v JOIN elig o ON o.zone = v.zone AND o.product = v.product
  WHERE v.product IN (SELECT product FROM productinfos)
  GROUP BY v.request_id, v.product, v.zone, v.dest_pin),
zone_dist AS (SELECT product, zone, pincode, finalPrice, quantity FROM (
  SELECT o.product, o.zone, p.pincode, o.quantity,
    {_price('o.buyingPrice', _CHARGE_SQL.format(dest='p.pincode'))} AS finalPrice,
    ROW_NUMBER() OVER (PARTITION BY o.product, o.zone, p.pincode
      ORDER BY {_price('o.buyingPrice', _CHARGE_SQL.format(dest='p.pincode'))}, o.buyingPrice,
               o.quantity, o.pincodeNum NULLS FIRST) AS rn
  FROM elig o JOIN zp p ON p.zone = o.zone
  LEFT JOIN dist d ON d.sourcePincode = o.pincodeNum AND d.destPincode = p.pincode
  WHERE o.product IN (SELECT product FROM productinfos)) t WHERE rn = 1),
pin_dist AS (
  SELECT v.request_id, v.product, v.zone, v.dest_pin AS pincode,
    MIN({_price('o.buyingPrice', _CHARGE_SQL.format(dest='v.dest_pin'))}) AS price
  FROM preq v JOIN elig o ON o.zone = v.zone AND o.product = v.product
  LEFT JOIN dist d ON d.sourcePincode = o.pincodeNum AND d.destPincode = v.dest_pin
  WHERE v.product IN (SELECT product FROM productinfos)
  GROUP BY v.request_id, v.product, v.zone, v.dest_pin),
quotes AS (
  SELECT v.product, v.zone, v.pincode, 'FALCON' AS type,
    MIN(o.sellingPrice + {_CHARGE_SQL.format(dest='v.pincode')}) AS price
  FROM (SELECT DISTINCT product, zone, dest_pin AS pincode FROM preq) v
  JOIN zoneprices o ON o.zone = v.zone AND o.product = v.product
  LEFT JOIN dist d ON d.sourcePincode = o.pincodeNum AND d.destPincode = v.pincode
  WHERE o.sellingPrice IS NOT NULL AND o.quantity > 0
    AND (o.pincodeNum = v.pincode OR d.distance IS NOT NULL)
    AND v.product IN (SELECT product FROM productinfos)
  GROUP BY v.product, v.zone, v.pincode),
req_prices AS (
  SELECT request_id, 'pin' AS kind, product, zone, pincode, price, CAST(NULL AS INT) AS quantity
  FROM pin_flat
  UNION ALL
  SELECT v.request_id, 'zone' AS kind, f.product, f.zone, f.pincode, f.finalPrice AS price, f.quantity
  FROM vreq v JOIN zone_flat f ON f.zone = v.zone AND f.product = v.product
  WHERE v.kind = 'zone')
"""

_OFFER_COLS_SQL = "zone, product, pincodeNum, buyingPrice, sellingPrice, quantity"
_SQL = {
    "q29_merged_quotes": """
, q AS (SELECT product, pincode, MIN(price) AS price FROM quotes GROUP BY product, pincode)
SELECT COALESCE(s.product, q.product) AS product, COALESCE(s.pincode, q.pincode) AS pincode,
  COALESCE(q.price, CAST(s.price AS DOUBLE)) AS price, CASE WHEN q.product IS NULL THEN s.quantity END AS quantity, CASE WHEN q.product IS NULL THEN 'STORED' ELSE 'FALCON' END AS type
FROM product_prices s FULL OUTER JOIN q ON s.product = q.product AND s.pincode = q.pincode""",
    "q30_one_zone_match": f"SELECT {_OFFER_COLS_SQL} FROM zoneprices WHERE zone = 'ASIA' AND quantity = 10",
    "q31_single_request": f"""
SELECT product, zone, CAST(500001 AS INT) AS pincode, MIN({_price('buyingPrice', _dbl(PIN_CHARGE))}) AS price FROM elig
WHERE product = 1 AND zone = 'ASIA' AND product IN (SELECT product FROM productinfos) GROUP BY product, zone""",
    "q32_min_price_core": f"""
SELECT v.request_id, v.dest_pin AS destPin, MIN({_price('o.buyingPrice', _dbl(PIN_CHARGE))}) AS price
FROM preq v JOIN elig o ON o.zone = v.zone AND o.product = v.product GROUP BY v.request_id, v.dest_pin""",
    "q33_price_map_entries": "SELECT product, pincode, price, quantity FROM upd",
    "q34_sql_functions": f"""
SELECT {_OFFER_COLS_SQL}, {_price('buyingPrice', _dbl(PIN_CHARGE))} AS finalPrice,
  CAST(FLOOR(sellingPrice + CAST(0.5 AS DOUBLE)) AS BIGINT) AS roundedSelling FROM elig""",
    "q35_string_keys": """
SELECT request_id, kind, 'p-' || CAST(product AS VARCHAR) AS product, zone, pincode, price, quantity FROM req_prices""",
    "q01_zone_product_offers": f"""
SELECT {_OFFER_COLS_SQL} FROM zoneprices o
WHERE EXISTS (SELECT 1 FROM vreq v WHERE v.zone = o.zone AND v.product = o.product)""",
    "q02_fetch_by_id": f"""
SELECT {_OFFER_COLS_SQL} FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY product ORDER BY zone NULLS FIRST, pincodeNum NULLS FIRST,
    buyingPrice NULLS FIRST, sellingPrice NULLS FIRST, quantity NULLS FIRST) AS rn
  FROM zoneprices WHERE product IN (SELECT product FROM vreq)) t WHERE rn = 1""",
    "q03_known_products": """
SELECT DISTINCT v.zone, v.product FROM vreq v
WHERE v.product IN (SELECT product FROM productinfos)
  AND EXISTS (SELECT 1 FROM zoneprices o WHERE o.zone = v.zone AND o.product = v.product)""",
    "q04_eligible_offers": f"SELECT {_OFFER_COLS_SQL} FROM elig",
    "q05_nested_projection": f"SELECT {_OFFER_COLS_SQL} FROM elig",
    "q06_price_flat": f"""
SELECT zone, product, pincodeNum, buyingPrice, quantity,
  {_price('buyingPrice', _dbl(PIN_CHARGE))} AS finalPrice FROM elig""",
    "q07_price_distance": f"""
SELECT v.request_id, o.zone, o.product, o.pincodeNum, v.dest_pin AS destPincode, o.buyingPrice, o.quantity,
  {_CHARGE_SQL.format(dest='v.dest_pin')} AS charge,
  {_price('o.buyingPrice', _CHARGE_SQL.format(dest='v.dest_pin'))} AS finalPrice
FROM preq v JOIN elig o ON o.zone = v.zone AND o.product = v.product
LEFT JOIN dist d ON d.sourcePincode = o.pincodeNum AND d.destPincode = v.dest_pin""",
    "q08_quote_selling": f"""
SELECT v.request_id, o.product, o.pincodeNum, v.dest_pin AS destPincode,
  o.sellingPrice + {_CHARGE_SQL.format(dest='v.dest_pin')} AS price
FROM preq v JOIN zoneprices o ON o.zone = v.zone AND o.product = v.product
LEFT JOIN dist d ON d.sourcePincode = o.pincodeNum AND d.destPincode = v.dest_pin
WHERE o.sellingPrice IS NOT NULL AND o.quantity > 0
  AND (o.pincodeNum = v.dest_pin OR d.distance IS NOT NULL)""",
    "q09_attach_destination": """
SELECT v.request_id, v.dest_pin AS destPin, o.zone, o.product, o.pincodeNum, o.buyingPrice,
  o.sellingPrice, o.quantity
FROM preq v JOIN zoneprices o ON o.zone = v.zone AND o.product = v.product""",
    "q10_min_for_pin": "SELECT request_id, product, zone, pincode, price FROM pin_flat",
    "q11_min_for_zone_flat": "SELECT product, zone, pincode, finalPrice, quantity FROM zone_flat",
    "q12_min_for_zone_distance": "SELECT product, zone, pincode, finalPrice, quantity FROM zone_dist",
    "q13_min_quote_for_pins": "SELECT * FROM quotes",
    "q14_argmin_per_key": f"""
SELECT zone, product, {_price('buyingPrice', _dbl(ZONE_CHARGE))} AS finalPrice, quantity, pincodeNum,
  buyingPrice FROM zw""",
    "q15_top_k_offers": f"""
SELECT zone, product, CAST(offer_rank AS INTEGER) AS offer_rank, finalPrice, buyingPrice, quantity,
  pincodeNum FROM (
  SELECT zone, product, buyingPrice, quantity, pincodeNum,
    {_price('buyingPrice', _dbl(ZONE_CHARGE))} AS finalPrice,
    ROW_NUMBER() OVER (PARTITION BY zone, product ORDER BY {_price('buyingPrice', _dbl(ZONE_CHARGE))},
      buyingPrice, quantity, pincodeNum NULLS FIRST) AS offer_rank
  FROM elig) t WHERE offer_rank <= 3""",
    "q16_distance_kv": """
SELECT CAST(sourcePincode AS VARCHAR) || '_' || CAST(destPincode AS VARCHAR) AS src_dest,
  CAST(distance AS VARCHAR) AS distance
FROM pincodedistances WHERE sourcePincode IS NOT NULL AND destPincode IS NOT NULL""",
    "q17_distance_lookup": """
SELECT CAST(sourcePincode AS VARCHAR) || '_' || CAST(destPincode AS VARCHAR) AS src_dest,
  CAST(distance AS DOUBLE) AS distance
FROM pincodedistances
WHERE CAST(sourcePincode AS VARCHAR) || '_' || CAST(destPincode AS VARCHAR) IN (
  SELECT CAST(o.pincodeNum AS VARCHAR) || '_' || CAST(v.dest_pin AS VARCHAR)
  FROM preq v JOIN zoneprices o ON o.zone = v.zone AND o.product = v.product
  WHERE o.pincodeNum IS NOT NULL)""",
    "q18_price_updates": """
SELECT product, 'prices.' || CAST(pincode AS VARCHAR) AS path, pincode, price, quantity FROM upd""",
    "q19_merged_prices": """
SELECT COALESCE(s.product, u.product) AS product, COALESCE(s.pincode, u.pincode) AS pincode,
  CASE WHEN u.product IS NOT NULL THEN u.price ELSE s.price END AS price,
  CASE WHEN u.product IS NOT NULL THEN u.quantity ELSE s.quantity END AS quantity
FROM product_prices s FULL OUTER JOIN upd u ON s.product = u.product AND s.pincode = u.pincode""",
    "q20_changed_products": """
SELECT CAST(COUNT(DISTINCT u.product) AS BIGINT) AS n
FROM upd u LEFT JOIN product_prices s ON s.product = u.product AND s.pincode = u.pincode
WHERE s.product IS NULL
   OR NOT (u.price IS NOT DISTINCT FROM s.price AND u.quantity IS NOT DISTINCT FROM s.quantity)""",
    "q21_validated_requests": "SELECT request_id, kind, product, zone, dest_pin, reject_reason FROM vr",
    "q22_min_for_requests": "SELECT * FROM req_prices",
    "q23_kv_overwrite_roundtrip": """
SELECT CAST(sourcePincode AS VARCHAR) || '_' || CAST(destPincode AS VARCHAR) AS src_dest,
  CAST(distance AS VARCHAR) AS distance
FROM pincodedistances WHERE sourcePincode IS NOT NULL AND destPincode IS NOT NULL""",
    "q24_stream_requests": "SELECT * FROM req_prices",
    "q26_min_for_requests_distance": """
SELECT request_id, 'pin' AS kind, product, zone, pincode, price, CAST(NULL AS INT) AS quantity FROM pin_dist
UNION ALL
SELECT v.request_id, 'zone' AS kind, f.product, f.zone, f.pincode, f.finalPrice AS price, f.quantity
FROM vreq v JOIN zone_dist f ON f.zone = v.zone AND f.product = v.product WHERE v.kind = 'zone'""",
    "q27_distance_kv_first10": """
SELECT src_dest, distance FROM (
  SELECT CAST(sourcePincode AS VARCHAR) || '_' || CAST(destPincode AS VARCHAR) AS src_dest,
    CAST(distance AS VARCHAR) AS distance
  FROM pincodedistances WHERE sourcePincode IS NOT NULL AND destPincode IS NOT NULL) t
ORDER BY src_dest, distance LIMIT 10""",
    "q28_recompute_changed": """
, lastu AS (
  SELECT product, pincode, price, quantity FROM (
    SELECT product, pincode, price, quantity,
      ROW_NUMBER() OVER (PARTITION BY product, pincode ORDER BY request_id DESC) AS rn
    FROM req_prices) t WHERE rn = 1)
SELECT CAST(COUNT(DISTINCT u.product) AS BIGINT) AS n
FROM lastu u LEFT JOIN product_prices s ON s.product = u.product AND s.pincode = u.pincode
WHERE s.product IS NULL
   OR NOT (u.price IS NOT DISTINCT FROM s.price AND u.quantity IS NOT DISTINCT FROM s.quantity)""",
    "q25_stream_merge_prices": """
, lastu AS (
  SELECT product, pincode, price, quantity FROM (
    SELECT product, pincode, price, quantity,
      ROW_NUMBER() OVER (PARTITION BY product, pincode ORDER BY request_id DESC) AS rn
    FROM req_prices) t WHERE rn = 1)
SELECT COALESCE(s.product, u.product) AS product, COALESCE(s.pincode, u.pincode) AS pincode,
  CASE WHEN u.product IS NOT NULL THEN u.price ELSE s.price END AS price,
  CASE WHEN u.product IS NOT NULL THEN u.quantity ELSE s.quantity END AS quantity
FROM product_prices s FULL OUTER JOIN lastu u ON s.product = u.product AND s.pincode = u.pincode""",
}


_LAST = """
, lastu AS (
  SELECT product, pincode, price, quantity FROM (
    SELECT product, pincode, price, quantity,
      ROW_NUMBER() OVER (PARTITION BY product, pincode ORDER BY request_id DESC) AS rn
    FROM req_prices) t WHERE rn = 1)"""
_SQL |= {
    "q36_merge_touched_parts": _SQL["q25_stream_merge_prices"],
    "q37_modified_per_product": _LAST + """
SELECT u.product, COUNT(*) AS updated, COUNT(CASE WHEN s.product IS NULL OR NOT (u.price IS NOT DISTINCT FROM s.price
  AND u.quantity IS NOT DISTINCT FROM s.quantity) THEN 1 END) AS modified
FROM lastu u LEFT JOIN product_prices s ON s.product = u.product AND s.pincode = u.pincode GROUP BY u.product""",
    "q38_recompute_zone_version": _SQL["q19_merged_prices"],
    "q39_read_options": _SQL["q04_eligible_offers"],
    "q40_kv_keyed_lookup": _SQL["q17_distance_lookup"],
    "q41_sql_pin_prices": _SQL["q10_min_for_pin"],
    "q42_sql_zone_prices": _SQL["q11_min_for_zone_flat"],
    "q43_sql_distances": _SQL["q17_distance_lookup"],
    "q44_quotes_by_threshold": _SQL["q13_min_quote_for_pins"],
    "q45_zone_prices_by_arrays": _SQL["q12_min_for_zone_distance"],
}


def oracle_sql() -> dict[str, str]:
    head = fixture_cte().rstrip() + _EXTRA_CTE
    return {name: head + sql for name, sql in _SQL.items()} | _llm()[1]
