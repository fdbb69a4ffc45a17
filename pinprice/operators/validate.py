"""Request validation: tag every request with a reject reason (or null)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinprice.functions.expr import normalize_zone
from pinprice.operators.joins import join_small

# Reject reasons, in the order they are tested.
NULL_PRODUCT = "null_product"
BAD_KIND = "bad_kind"
NULL_ZONE = "null_zone"
UNKNOWN_ZONE = "unknown_zone"
NULL_PINCODE = "null_pincode"
BAD_PINCODE = "bad_pincode"

KINDS = ("pin", "zone")


def zones_of(pincodes: DataFrame) -> DataFrame:
    """The zones dimension: normalised distinct zone names of the pincodes."""
    return pincodes.select(normalize_zone("zone").alias("zone")).where(F.col("zone").isNotNull()).distinct()


def validate_requests(requests: DataFrame, zones: DataFrame) -> DataFrame:
    """Normalise the zone and add ``reject_reason`` (null for a valid request).

    A null destination pincode is only invalid for kind ``pin``; a zone
    request prices every pincode of its zone.
    """
    z = zones.select(F.col("zone").alias("_known_zone")).distinct()
    r = requests.withColumn("zone", normalize_zone("zone"))
    r = join_small(r, z, r["zone"] == z["_known_zone"], "left")
    reason = (F.when(F.col("product").isNull(), F.lit(NULL_PRODUCT))
              .when(~F.col("kind").isin(*KINDS) | F.col("kind").isNull(), F.lit(BAD_KIND))
              .when(F.col("zone").isNull(), F.lit(NULL_ZONE))
              .when(F.col("_known_zone").isNull(), F.lit(UNKNOWN_ZONE))
              .when((F.col("kind") == "pin") & F.col("dest_pin").isNull(), F.lit(NULL_PINCODE))
              .when((F.col("kind") == "pin") & (F.col("dest_pin") <= 0), F.lit(BAD_PINCODE)))
    return r.withColumn("reject_reason", reason).drop("_known_zone")


def valid_requests(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected_requests(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("reject_reason").isNotNull())
