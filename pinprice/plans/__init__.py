"""Composite jobs: zone/pincode price, quotes, requests, distance export."""

from pinprice.plans.charges import attach_charge
from pinprice.plans.distances import distance_pairs, export_distances, lookup_distance
from pinprice.plans.jobs import recompute_prices, recompute_quotes, recompute_zone_prices
from pinprice.plans.offers import (
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
    requested_offers,
    seller_winners,
    store_seller_winners,
    store_zone_winners,
    top_k_offers,
    zone_pincodes,
    zone_sets,
    zone_winners,
)
from pinprice.plans.requests import price_requests

__all__ = [
    "argmin_per_key", "attach_charge", "attach_destination", "distance_pairs",
    "eligible_offers", "export_distances", "lookup_distance", "min_entry_for_pincodes", "min_price",
    "min_price_for_pin", "min_price_for_pins", "min_price_for_zone",
    "min_quote_for_pins", "price_for_destinations", "price_offers",
    "price_requests", "priceable_keys", "recompute_prices", "recompute_quotes",
    "recompute_zone_prices", "requested_offers", "seller_winners", "store_seller_winners", "store_zone_winners",
    "top_k_offers", "zone_pincodes", "zone_sets", "zone_winners",
]
