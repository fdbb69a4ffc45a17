"""Distance table export to a key-value form, and batch key lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinprice.functions.expr import dist_key, distance_text


def distance_pairs(distances: DataFrame) -> DataFrame:
    """(src_dest, distance DOUBLE) key/value pairs; rows with a null pincode
    have no key and are left out."""
    return (distances.where(F.col("sourcePincode").isNotNull() & F.col("destPincode").isNotNull())
            .select(dist_key("sourcePincode", "destPincode").alias("src_dest"),
                    F.col("distance").cast("double").alias("distance")))


def export_distances(distances: DataFrame, limit: int | None = None) -> DataFrame:
    """Key-value export ``(src_dest STRING, distance STRING)``, read by name.

    Full export by default; ``limit`` keeps the first rows in key order so
    the result is deterministic.
    """
    kv = distance_pairs(distances).select("src_dest", distance_text("distance").alias("distance"))
    if limit is not None:
        kv = kv.orderBy("src_dest", "distance").limit(limit)
    return kv


def lookup_distance(distances: DataFrame, keys: DataFrame, key_col: str = "src_dest") -> DataFrame:
    """Every distance stored under each requested key (multi-valued lookup).

    ``keys`` is a DataFrame with a ``key_col`` string column; duplicates in
    it do not duplicate the answer. Output: src_dest, distance (double).
    """
    k = keys.select(F.col(key_col).alias("src_dest")).where(F.col("src_dest").isNotNull()).distinct()
    return distance_pairs(distances).join(k, "src_dest", "left_semi")
