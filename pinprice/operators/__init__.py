"""Join, aggregate and validation operators (DataFrame -> DataFrame)."""

from pinprice.operators.aggregate import argmin, last_per_key, top_k
from pinprice.operators.joins import (
    DEFAULT_BROADCAST_ROWS,
    expand_join,
    fits,
    grid_join,
    join_small,
    task_count,
)
from pinprice.operators.validate import (
    rejected_requests,
    valid_requests,
    validate_requests,
    zones_of,
)

__all__ = [
    "DEFAULT_BROADCAST_ROWS", "argmin", "expand_join", "fits", "grid_join",
    "join_small", "last_per_key", "rejected_requests", "task_count", "top_k",
    "valid_requests", "validate_requests", "zones_of",
]
