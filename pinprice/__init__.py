"""Delivered-price analytics on PySpark.

For every product, sales zone and destination pincode, find the seller offer
with the lowest delivered price and merge the winners into a per-product price
table. Every job is a DataFrame -> DataFrame function; the session is passed
in, never created by an operator.
"""

from pinprice.functions.expr import delivered_price, round_half_up
from pinprice.functions.sql import register_sql_functions
from pinprice.functions.tables import register_table_functions
from pinprice.operators.validate import validate_requests, zones_of
from pinprice.plans import (
    export_distances,
    lookup_distance,
    min_price_for_pin,
    min_price_for_pins,
    min_price_for_zone,
    min_quote_for_pins,
    price_requests,
    recompute_prices,
    recompute_quotes,
    recompute_zone_prices,
)
from pinprice.session import build_session, shared_dir
from pinprice.sources.sinks import (
    changed_count,
    lookup_keys,
    merge_into_table,
    merge_parts,
    merge_values,
    modified_products,
    price_updates,
    read_parts,
    replace_kv,
    write_bucketed,
    write_kv,
    write_parts,
)
from pinprice.sources.tables import read_offers, read_table, write_offers
from pinprice.streaming import current_prices, read_updates, stream_merge_prices, stream_price_requests

__all__ = [
    "build_session", "changed_count", "current_prices", "delivered_price", "export_distances",
    "lookup_distance", "lookup_keys", "merge_into_table", "merge_parts", "merge_values",
    "min_price_for_pin", "min_price_for_pins", "min_price_for_zone", "min_quote_for_pins",
    "modified_products", "price_requests", "price_updates", "read_offers", "read_parts",
    "read_table", "read_updates", "recompute_prices", "recompute_quotes", "recompute_zone_prices",
    "register_sql_functions", "register_table_functions", "replace_kv", "round_half_up",
    "shared_dir", "stream_merge_prices", "stream_price_requests", "validate_requests",
    "write_bucketed", "write_kv", "write_offers", "write_parts", "zones_of",
]
