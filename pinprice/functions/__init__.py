"""Column expressions (all JVM-side, no Python UDFs)."""

from pinprice.functions.expr import (
    CARRIER,
    MARGIN,
    PIN_CHARGE,
    ZONE_CHARGE,
    delivered_price,
    dist_key,
    distance_text,
    eligible_buying,
    eligible_selling,
    normalize_zone,
    price_path,
    round_half_up,
)

__all__ = [
    "CARRIER", "MARGIN", "PIN_CHARGE", "ZONE_CHARGE", "delivered_price",
    "dist_key", "distance_text", "eligible_buying", "eligible_selling",
    "normalize_zone", "price_path", "round_half_up",
]
