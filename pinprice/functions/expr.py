"""Scalar column expressions of the price rules.

Everything here returns a ``Column`` so Catalyst can fold constants, push
predicates into the scan and keep the work inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the price rules:
#   margin on the buying price           0.02
#   flat charge, single-pincode price  17.09
#   flat charge, whole-zone price      35.99
#   carrier label of a selling quote     "FALCON"
MARGIN = 0.02
PIN_CHARGE = 17.09
ZONE_CHARGE = 35.99
CARRIER = "FALCON"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _num(x: float | int | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def round_half_up(x: str | Column) -> Column:
    """Half-up rounding toward +inf to a BIGINT (77 for 76.5, -2 for -2.5).

    ``F.round`` rounds half away from zero and ``F.bround`` half to even;
    neither matches, so this is floor(x + 0.5).
    """
    return F.floor(_col(x) + F.lit(0.5))


def delivered_price(buying_price: str | Column,
                    charge: float | int | Column = ZONE_CHARGE,
                    margin: float = MARGIN) -> Column:
    """round_half_up(b + margin*b + charge), evaluated in double, left to right."""
    b = _col(buying_price).cast("double")
    return round_half_up(b + F.lit(float(margin)) * b + _num(charge))


def eligible_buying(prefix: str = "") -> Column:
    """Offer has a buying price and stock (a null quantity is not in stock)."""
    return (F.col(prefix + "buyingPrice").isNotNull()
            & (F.col(prefix + "quantity") > 0))


def eligible_selling(prefix: str = "") -> Column:
    """Offer has a selling price and stock."""
    return (F.col(prefix + "sellingPrice").isNotNull()
            & (F.col(prefix + "quantity") > 0))


def normalize_zone(zone: str | Column) -> Column:
    """Zone names are compared upper-case and trimmed."""
    return F.upper(F.trim(_col(zone)))


def dist_key(src: str | Column, dest: str | Column) -> Column:
    """Composite key ``<src>_<dest>``; null when either side is null."""
    s, d = _col(src), _col(dest)
    return F.when(s.isNotNull() & d.isNotNull(),
                  F.concat_ws("_", s.cast("string"), d.cast("string")))


def distance_text(distance: str | Column) -> Column:
    """Distance as text, Java ``String.valueOf(double)`` style (30.0 -> "30.0")."""
    return _col(distance).cast("string")


def price_path(pincode: str | Column) -> Column:
    """Dotted path of one entry of the per-product price object."""
    return F.concat(F.lit("prices."), _col(pincode).cast("string"))
