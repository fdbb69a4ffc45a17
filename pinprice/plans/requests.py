"""A table of price requests, priced in one job.

Each request row is (request_id, kind, product, zone, dest_pin):
kind ``pin`` prices one destination (flat charge 17.09 by default),
kind ``zone`` prices every pincode of the zone (flat charge 35.99 by
default, winning quantity included). Invalid requests are tagged and left
out; unknown products and products without an eligible offer give no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinprice.functions.expr import PIN_CHARGE, ZONE_CHARGE, delivered_price
from pinprice.operators.joins import DEFAULT_BROADCAST_ROWS, expand_join, fits
from pinprice.operators.validate import valid_requests, validate_requests, zones_of
from pinprice.plans.offers import (
    min_price_for_pins,
    min_price_for_zone,
    requested_offers,
    seller_winners,
    zone_pincodes,
    zone_winners,
)
from pinprice.session import shared_dir

OUTPUT = ["request_id", "kind", "product", "zone", "pincode", "price", "quantity"]


def price_requests(requests: DataFrame, offers: DataFrame, pincodes: DataFrame,
                   products: DataFrame | None = None,
                   pin_charge: float = PIN_CHARGE, zone_charge: float = ZONE_CHARGE,
                   distances: DataFrame | None = None, on_missing: str = "zero",
                   max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
                   winners: DataFrame | None = None,
                   sellers: DataFrame | None = None) -> DataFrame:
    """Validate, then price every valid request.

    ``winners`` (flat charge) / ``sellers`` (distance charge) are
    precomputed ``zone_winners`` / ``seller_winners`` tables, e.g. from
    ``store_zone_winners`` / ``store_seller_winners``; the offers are then
    not read.

    Output: request_id, kind, product, zone, pincode, price, quantity
    (quantity is null for kind ``pin``, as a single-pincode write carries
    only the price).
    """
    v = valid_requests(validate_requests(requests, zones_of(pincodes)))
    if distances is None:
        # one winners table for both kinds, so the offers are aggregated once:
        # each request row meets the pincodes of its zone only when it is a
        # zone request; a pin request keeps its single destination
        w = winners if winners is not None else zone_winners(requested_offers(offers, v), products)
        x = v.select("request_id", "kind", "zone", "product", "dest_pin").join(
            w, ["zone", "product"], "inner")
        pins = zone_pincodes(pincodes)
        if fits(pins, max_broadcast_rows):
            p = pins.select(F.col("zone").alias("_pz"), F.col("pincode").alias("_pin"))
            # a pin request has a null key, so it probes no pincodes
            x = x.withColumn("_zone", F.when(F.col("kind") == "zone", F.col("zone")))
            y = x.join(F.broadcast(p), F.col("_zone") == F.col("_pz"), "left").where(
                (F.col("kind") == "pin") | F.col("_pin").isNotNull())
            is_pin = F.col("kind") == "pin"
            return y.select(
                "request_id", "kind", "product", "zone",
                F.when(is_pin, F.col("dest_pin")).otherwise(F.col("_pin")).alias("pincode"),
                F.when(is_pin, delivered_price("buyingPrice", pin_charge))
                 .otherwise(delivered_price("buyingPrice", zone_charge)).alias("price"),
                F.when(is_pin, F.lit(None).cast("int")).otherwise(F.col("quantity")).alias("quantity"))
        pin_out = x.where(F.col("kind") == "pin").select(
            "request_id", "kind", "product", "zone", F.col("dest_pin").alias("pincode"),
            delivered_price("buyingPrice", pin_charge).alias("price"),
            F.lit(None).cast("int").alias("quantity"))
        z = expand_join(x.where(F.col("kind") == "zone").drop("dest_pin"), pins, "zone",
                        max_broadcast_rows)
        zone_out = z.select("request_id", "kind", "product", "zone", "pincode",
                            delivered_price("buyingPrice", zone_charge).alias("price"), "quantity")
        return pin_out.unionByName(zone_out)

    if sellers is None:
        # one aggregation of the requested offers for both kinds, kept in the checkpoint folder
        shared_dir(offers.sparkSession, unique=False)
        sellers = seller_winners(requested_offers(offers, v), products).checkpoint()
    pin_req = v.where(F.col("kind") == "pin")
    pin_out = min_price_for_pins(offers, pin_req, products, pin_charge, distances, on_missing, sellers)
    pin_out = pin_out.select("request_id", F.lit("pin").alias("kind"), "product", "zone", "pincode",
                             "price", F.lit(None).cast("int").alias("quantity"))
    zr = v.where(F.col("kind") == "zone").select("request_id", "zone", "product")
    keys = zr.select("zone", "product").distinct()
    res = min_price_for_zone(offers, pincodes, products, None, zone_charge, distances, on_missing,
                             max_broadcast_rows, sellers=sellers.join(keys, ["zone", "product"], "left_semi"))
    zone_out = zr.join(res, ["zone", "product"], "inner").select(
        "request_id", F.lit("zone").alias("kind"), "product", "zone", "pincode",
        F.col("finalPrice").alias("price"), "quantity")
    return pin_out.unionByName(zone_out)
