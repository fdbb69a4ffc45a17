"""Distance charge: seller pincode -> destination pincode lookup as a join.

Replaces a per-row database lookup with one join. The distance table is
bounded by (number of pincodes)^2; it is broadcast only when its row count
is proven under the bound, otherwise both sides are shuffled on the pincode
pair and adaptive execution splits a skewed (hot seller) partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pinprice.operators.joins import DEFAULT_BROADCAST_ROWS, expand_join, fits, join_small

ON_MISSING = ("zero", "drop")


def listed(distances: DataFrame) -> DataFrame:
    """The entries that hold a distance: a null or NaN one is no entry."""
    return distances.where(F.col("distance").isNotNull() & ~F.isnan("distance"))


def charge_arrays(sellers: DataFrame, pins: DataFrame, distances: DataFrame, on_missing: str = "zero",
                  max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """The charges of a seller pincode to all destinations of a bucket as one row, for distance tables of any size.

    ``sellers``: zone, pincodeNum, _db (distinct); ``pins``: zone, pincode,
    _db. Output: zone, pincodeNum, _db, ``entries`` (array of pincode and
    charge, one per destination that the seller serves), ``cmin``, ``cmax``
    (least and greatest charge) and ``full`` (it serves the whole bucket).
    Rules as in ``attach_charge``; of several distances the least counts. An
    array holds at most a bucket's destinations, and no step sees sellers x
    products: only the distance table and the pincodes are moved.
    """
    d = listed(distances).where(F.col("sourcePincode") != F.col("destPincode"))
    d = d.groupBy(F.col("sourcePincode").alias("pincodeNum"), F.col("destPincode").alias("pincode")).agg(
        F.min("distance").alias("charge"))
    near = join_small(d, pins, "pincode", max_broadcast_rows=max_broadcast_rows)
    near = near.groupBy("zone", "_db", "pincodeNum").agg(
        F.array_sort(F.collect_list(F.struct("pincode", "charge"))).alias("near"))
    dests = pins.groupBy("zone", "_db").agg(F.array_sort(F.collect_list("pincode")).alias("dests"))
    x = expand_join(sellers, dests, ["zone", "_db"], max_broadcast_rows)
    x = x.join(near, ["zone", "_db", "pincodeNum"], "left")
    known = F.coalesce("near", F.array().cast("array<struct<pincode:int,charge:double>>"))
    # charge 0: the seller's own pincode, and (zero mode) destinations without a distance
    free = (F.array_except("dests", F.transform(known, lambda e: e["pincode"])) if on_missing == "zero"
            else F.filter("dests", lambda p: p == F.col("pincodeNum")))
    entries = F.concat(known, F.transform(free, lambda p: F.struct(p.alias("pincode"), F.lit(0.0).alias("charge"))))
    x = x.withColumn("entries", entries).where(F.size("entries") > 0)
    charges = F.transform("entries", lambda e: e["charge"])
    return x.select("zone", "pincodeNum", "_db", "entries", F.array_min(charges).alias("cmin"),
                    F.array_max(charges).alias("cmax"), (F.size("entries") == F.size("dests")).alias("full"))


def seller_numbers(sellers: DataFrame) -> DataFrame:
    """zone, pincodeNum, _i: the seller pincodes of every zone, numbered from 0."""
    order = Window.partitionBy("zone").orderBy("pincodeNum")
    return sellers.select("zone", "pincodeNum").distinct().withColumn("_i", F.row_number().over(order) - 1)


def charges_by_seller(numbers: DataFrame, pins: DataFrame, distances: DataFrame, on_missing: str = "zero",
                      max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """The columns of ``pins`` and ``charges``: every destination's charges as one array, by the sellers' numbers.

    ``numbers``: zone, pincodeNum, _i from 0 (``seller_numbers``). A seller
    that doesn't serve the destination has a null there. Rules as in
    ``attach_charge``; of several distances the least counts. As many charges
    as the zones have pairs of seller and destination pincodes.
    """
    d = listed(distances).groupBy(F.col("sourcePincode").alias("pincodeNum"), F.col("destPincode").alias("pincode")).agg(
        F.min("distance").alias("near"))
    x = expand_join(pins, numbers, "zone", max_broadcast_rows).join(d, ["pincodeNum", "pincode"], "left")
    far = F.coalesce("near", F.lit(0.0)) if on_missing == "zero" else F.col("near")
    charge = F.when(F.col("pincodeNum") == F.col("pincode"), F.lit(0.0)).otherwise(far)
    each = x.groupBy(*pins.columns).agg(F.array_sort(F.collect_list(F.struct("_i", charge.alias("charge")))).alias("each"))
    return each.select(*pins.columns, F.transform("each", lambda e: e["charge"]).alias("charges"))


def attach_charge(rows: DataFrame, distances: DataFrame, src: str, dest: str,
                  on_missing: str = "zero", charge_col: str = "charge",
                  broadcast: bool | None = None,
                  max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Add ``charge`` = distance(src -> dest) to every row.

    * source = destination -> 0;
    * an entry without a distance (null or NaN) is no entry;
    * pair missing -> 0 (``on_missing="zero"``) or the row is dropped
      (``"drop"``);
    * several distances for one pair -> one row per distance (callers take
      the minimum price, so the nearest entry wins).

    ``broadcast=None`` proves the size of ``distances`` first; True/False
    skip the check when the caller already knows.
    """
    if on_missing not in ON_MISSING:
        raise ValueError(f"on_missing must be one of {ON_MISSING}")
    d = listed(distances).select(F.col("sourcePincode").alias("_d_src"),
                                 F.col("destPincode").alias("_d_dest"),
                                 F.col("distance").alias("_d_dist"))
    if broadcast is None:
        broadcast = fits(d, max_broadcast_rows)
    if broadcast:
        d = F.broadcast(d)
    cond = (F.col(src) == F.col("_d_src")) & (F.col(dest) == F.col("_d_dest"))
    j = rows.join(d, cond, "left")
    same = F.col(src) == F.col(dest)
    if on_missing == "drop":
        j = j.where(same | F.col("_d_dist").isNotNull())
    charge = F.when(same, F.lit(0.0)).otherwise(F.coalesce(F.col("_d_dist"), F.lit(0.0)))
    return j.withColumn(charge_col, charge).drop("_d_src", "_d_dest", "_d_dist")
