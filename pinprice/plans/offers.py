"""Least delivered price per product, zone and destination pincode.

Rewrites that keep the expansion (products x pincodes) as small as the
output (Catalyst does not do these on its own):

1. With a flat charge the delivered price is monotone in the buying price
   and does not depend on the destination, so the winner of a (zone,
   product) is computed once (partial + final aggregate) and only then
   joined to the zone's pincodes.
2. With a distance charge the winner of each (zone, product, seller
   pincode) is computed before expanding to destinations: for one seller
   pincode and one destination the charge is fixed, so the cheaper buying
   price always wins there.

Total order on ties: (finalPrice, buyingPrice, quantity, pincodeNum), all
ascending; the price itself never depends on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pinprice.functions.expr import (
    CARRIER,
    MARGIN,
    PIN_CHARGE,
    ZONE_CHARGE,
    delivered_price,
    eligible_buying,
    eligible_selling,
    price_path,
    round_half_up,
)
from pinprice.operators.aggregate import argmin, top_k
from pinprice.operators.joins import (
    DEFAULT_BROADCAST_BYTES,
    DEFAULT_BROADCAST_ROWS,
    expand_join,
    fits,
    join_small,
    row_count,
    task_count,
)
from pinprice.plans.charges import attach_charge, charge_arrays, charges_by_seller, listed, seller_numbers
from pinprice.session import dropped, materialised, shared_dir

TIE_ORDER = ("finalPrice", "buyingPrice", "quantity", "pincodeNum")


def _known(df: DataFrame, products: DataFrame | None) -> DataFrame:
    """Keep rows whose product exists in the catalogue (left semi join)."""
    if products is None:
        return df
    return df.join(products.select("product"), "product", "left_semi")


def _zone(df: DataFrame, zone: str | None) -> DataFrame:
    return df if zone is None else df.where(F.col("zone") == F.lit(zone.strip().upper()))


def priceable_keys(requests: DataFrame, offers: DataFrame,
                   products: DataFrame | None = None) -> DataFrame:
    """Distinct requested (zone, product) pairs that pass the two gates a
    request meets before price: the product is in the catalogue and the
    zone has at least one offer for it. Both are semi joins, no action.
    """
    keys = _known(requests.select("zone", "product").distinct(), products)
    return keys.join(offers.select("zone", "product"), ["zone", "product"], "left_semi")


def eligible_offers(offers: DataFrame, by: str = "buying") -> DataFrame:
    """Offers with a price (buying or selling) and quantity > 0."""
    return offers.where(eligible_buying() if by == "buying" else eligible_selling())


def price_offers(offers: DataFrame, charge: float = PIN_CHARGE) -> DataFrame:
    """Eligible offers with their rounded delivered price ``finalPrice``."""
    return eligible_offers(offers).withColumn(
        "finalPrice", delivered_price("buyingPrice", charge))


def zone_winners(offers: DataFrame, products: DataFrame | None = None,
                 zone: str | None = None) -> DataFrame:
    """Cheapest eligible offer per (zone, product) for any flat charge.

    Ordered by (buyingPrice, quantity): with a flat charge this is the same
    order as (finalPrice, buyingPrice, quantity). Output: zone, product,
    buyingPrice, quantity, reduced by a packed hash aggregate.
    """
    e = eligible_offers(_zone(offers, zone)).select("zone", "product", "buyingPrice", "quantity")
    # eligibility guarantees non-null price and quantity
    w = argmin(e, ["zone", "product"], ["buyingPrice", "quantity"], not_null=True)
    return _known(w, products)


def requested_offers(offers: DataFrame, requests: DataFrame) -> DataFrame:
    """Offers of the requested (zone, product) keys only, so that nothing else is aggregated."""
    keys = requests.select("zone", "product").distinct()
    return offers.join(keys, ["zone", "product"], "left_semi")


def store_zone_winners(offers: DataFrame, table: str, path: str,
                       products: DataFrame | None = None, buckets: int = 16) -> DataFrame:
    """Aggregate the offers once into a stored winners table, bucketed by
    (zone, product), for jobs that price many small request batches: each
    batch then joins its requests to this table (only the batch shuffles)
    instead of scanning and aggregating all offers again. Rebuild it when
    the offers change."""
    from pinprice.sources.sinks import write_bucketed

    return write_bucketed(zone_winners(offers, products), table, path, ("zone", "product"), buckets)


def store_seller_winners(offers: DataFrame, table: str, path: str,
                         products: DataFrame | None = None, buckets: int = 16) -> DataFrame:
    """Distance-mode counterpart of ``store_zone_winners``: the per-(zone,
    product, seller pincode) winners stored once, bucketed by (zone, product)."""
    from pinprice.sources.sinks import write_bucketed

    return write_bucketed(seller_winners(offers, products), table, path, ("zone", "product"), buckets)


def seller_winners(offers: DataFrame, products: DataFrame | None = None,
                   zone: str | None = None, by: str = "buying") -> DataFrame:
    """Cheapest eligible offer per (zone, product, seller pincode)."""
    price = "buyingPrice" if by == "buying" else "sellingPrice"
    e = eligible_offers(_zone(offers, zone), by).select(
        "zone", "product", "pincodeNum", price, "quantity")
    # eligibility guarantees non-null price and quantity
    w = argmin(e, ["zone", "product", "pincodeNum"], [price, "quantity"], not_null=True)
    return _known(w, products)


def argmin_per_key(offers: DataFrame, charge: float = ZONE_CHARGE,
                   products: DataFrame | None = None) -> DataFrame:
    """Winning offer per (zone, product) with its price under a flat charge.

    The offers are reduced per seller by a hash aggregate first, so the struct
    minimum over the seller tie-break sorts only the few seller rows.
    """
    w = argmin(seller_winners(offers, products), ["zone", "product"], ["buyingPrice", "quantity", "pincodeNum"])
    return w.select("zone", "product",
                    delivered_price("buyingPrice", charge).alias("finalPrice"),
                    "quantity", "pincodeNum", "buyingPrice")


def zone_pincodes(pincodes: DataFrame, zone: str | None = None) -> DataFrame:
    """Distinct (zone, pincode) rows; duplicate pincode rows collapse."""
    p = pincodes.select(F.upper(F.trim(F.col("zone"))).alias("zone"), F.col("pincode"))
    p = p.where(F.col("zone").isNotNull() & F.col("pincode").isNotNull())
    return _zone(p, zone).distinct()


def zone_lists(pincodes: DataFrame, zone: str | None = None) -> DataFrame:
    """One row per zone: the array of its distinct pincodes (``pincodes``), for zones whose pincodes are proven few."""
    p = pincodes.select(F.upper(F.trim(F.col("zone"))).alias("zone"), F.col("pincode"))
    p = _zone(p.where(F.col("zone").isNotNull() & F.col("pincode").isNotNull()), zone)
    return p.groupBy("zone").agg(F.collect_set("pincode").alias("pincodes"))


def zone_sets(pincodes: DataFrame) -> DataFrame:
    """One row per pincode: the ascending array of all zones that list it (``zones``)."""
    return zone_pincodes(pincodes).groupBy("pincode").agg(F.array_sort(F.collect_set("zone")).alias("zones"))


def min_entry_for_pincodes(offers: DataFrame, pincodes: DataFrame, products: DataFrame | None = None,
                           charge: float = ZONE_CHARGE, winners: DataFrame | None = None,
                           max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
                           partitions: int | None = None, grouped: bool = False) -> DataFrame:
    """The one entry of every (product, pincode) over all zones that list the pincode: product, pincode, price,
    quantity, by least (price, quantity).

    Pincodes listed under several zones are resolved in the pincode dimension:
    every distinct *set* of zones is one destination group, its winners are
    the least of its zones' winners (a reduction of products x zone sets), and
    only then are they expanded, each pincode once. So nothing aggregates,
    shuffles or sorts the expansion. With a flat charge the price rises
    strictly with the buying price (the margin is not negative), so the order
    of winners is the order of entries.

    ``partitions`` deals the winners by product before they are expanded, so
    that the result can be merged into a state bucketed by product into as
    many buckets without moving the expansion. ``grouped``: pincodes of one
    product and entry as one row (``pincodes``, and ``paths`` of the entries),
    product by product if dealt, for sinks that walk them
    (``price_updates``, ``price_map``).
    """
    sets = zone_sets(pincodes)
    # a pincode lies in one set, so a set's least pincode is its number
    groups = sets.groupBy("zones").agg(F.min("pincode").alias("zones_id"), F.array_sort(F.collect_set("pincode")).alias("pincodes"))
    members = groups.select("zones_id", F.explode("zones").alias("zone"))
    w = (winners if winners is not None else zone_winners(offers, products)).select("zone", "product", "buyingPrice", "quantity")
    if partitions is not None:
        # dealt before they meet their sets, unless a grid would move them again
        few = fits(members, max_broadcast_rows)
        each = expand_join(w.repartition(partitions, "product") if few else w, members, "zone", max_broadcast_rows)
        each = each if few else each.repartition(partitions, "product")
        # not packed: the minimum of a struct is a sort aggregate, which leaves the rows in the order of its keys
        best = argmin(each, ["product", "zones_id"], ["buyingPrice", "quantity"])
    else:
        each = expand_join(w, members, "zone", max_broadcast_rows)
        best = argmin(each, ["zones_id", "product"], ["buyingPrice", "quantity"], not_null=True)
    best = best.select("product", "zones_id", delivered_price("buyingPrice", charge).alias("price"), "quantity")
    one = groups.select("zones_id", F.explode("pincodes").alias("pincode"))
    if grouped and fits(sets, max_broadcast_rows):
        paths = F.transform("pincodes", price_path)
        x = best.join(F.broadcast(groups.select("zones_id", "pincodes", paths.alias("paths"))), "zones_id")
        return x.select("product", "pincodes", "paths", "price", "quantity")
    x = expand_join(best, one, "zones_id", max_broadcast_rows)
    if grouped:
        return x.select("product", F.array("pincode").alias("pincodes"), F.array(price_path("pincode")).alias("paths"), "price", "quantity")
    return x.select("product", "pincode", "price", "quantity")


def _charge_bounds(pins: DataFrame, distances: DataFrame) -> DataFrame:
    """Per (zone, source pincode): least/greatest listed distance to the
    zone's other pincodes and how many of them are listed.

    Built from the distance table alone, so it has at most as many rows as
    that table (whose size is proven before it is broadcast).
    """
    d = listed(distances).select(F.col("sourcePincode").alias("pincodeNum"),
                                 F.col("destPincode").alias("pincode"), F.col("distance"))
    dz = d.join(F.broadcast(pins), "pincode", "inner").where(F.col("pincodeNum") != F.col("pincode"))
    return dz.groupBy("zone", "pincodeNum").agg(
        F.min("distance").alias("_dmin"), F.max("distance").alias("_dmax"),
        F.countDistinct("pincode").alias("_m"))


def _prune_dominated(s: DataFrame, pins: DataFrame, distances: DataFrame, on_missing: str,
                     broadcast_bounds: bool) -> DataFrame:
    """Add ``_lo`` / ``_hi``: a seller's price at its least and greatest
    charge over the zone (``_hi`` only when it is a candidate everywhere).

    The bounds have at most as many rows as the distance table: broadcast
    when that table's size is proven small, else a shuffle join with the
    per-seller winners (which are far fewer than the expansion it prunes).
    """
    bounds = _charge_bounds(pins, distances)
    if broadcast_bounds:
        bounds = F.broadcast(bounds)
    n = pins.groupBy("zone").agg(F.count("pincode").alias("_n"))
    own = pins.select("zone", F.col("pincode").alias("pincodeNum"), F.lit(True).alias("_self"))
    s = (s.join(bounds, ["zone", "pincodeNum"], "left")
         .join(F.broadcast(own), ["zone", "pincodeNum"], "left")
         .join(F.broadcast(n), "zone", "inner"))
    self_ = F.coalesce(F.col("_self"), F.lit(False))
    covered = F.coalesce(F.col("_m"), F.lit(0)) + self_.cast("long")
    # charge 0 occurs at the seller's own pincode, and (zero mode) at unlisted ones
    zero = (self_ | (covered < F.col("_n"))) if on_missing == "zero" else self_
    zero_c = F.when(zero, F.lit(0.0))
    cmin = F.least(F.col("_dmin"), zero_c)
    cmax = F.greatest(F.col("_dmax"), zero_c)
    full = F.lit(True) if on_missing == "zero" else (covered == F.col("_n"))
    return (s.withColumn("_lo", delivered_price("buyingPrice", cmin))
            .withColumn("_hi", F.when(full, delivered_price("buyingPrice", cmax)))
            .drop("_dmin", "_dmax", "_m", "_self", "_n"))


def _lists(sellers: DataFrame) -> DataFrame:
    """zone, product, _db, ``sellers``: the numbered sellers of every key as one list (a seller pincode has one offer there)."""
    offer = F.struct("_i", "buyingPrice", "quantity", "pincodeNum")
    return sellers.groupBy("zone", "product", "_db").agg(F.collect_list(offer).alias("sellers"))


def _in_chunks(sellers: DataFrame, chunk_rows: int) -> tuple[DataFrame, DataFrame]:
    """Split sellers, which lie by (zone, product, _db), into those of keys with at most ``chunk_rows`` sellers,
    as they lie, and the others dealt by chunks of that many (``_sc``)."""
    key = ["zone", "product", "_db"]
    s = (sellers.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*key)))
         .withColumn("_sc", F.floor((F.row_number().over(Window.partitionBy(*key).orderBy("pincodeNum")) - 1)
                                    / F.lit(chunk_rows)).cast("int")))
    few, many = F.col("_n") <= chunk_rows, F.col("_n") > chunk_rows
    return s.where(few).drop("_n", "_sc"), s.where(many).drop("_n").repartition(*key, "_sc")


def _lists_in_chunks(lists: DataFrame, chunk_rows: int) -> tuple[DataFrame, DataFrame]:
    """Split lists into those of at most ``chunk_rows`` sellers and the sellers of the others, dealt by chunks of that many (``_sc``)."""
    key = ["zone", "product", "_db"]
    many = lists.where(F.size("sellers") > chunk_rows).select(*key, F.posexplode(F.array_sort("sellers")).alias("_sc", "_o"))
    many = many.select(*key, F.floor(F.col("_sc") / F.lit(chunk_rows)).cast("int").alias("_sc"), "_o.pincodeNum",
                       "_o.buyingPrice", "_o.quantity")
    return lists.where(F.size("sellers") <= chunk_rows), many.repartition(*key, "_sc")


def _least(rows: DataFrame) -> DataFrame:
    """The least offer per (product, zone, pincode) of an expansion that lies by (zone, product, _db, _sc).

    ``_db`` is a function of the pincode: grouping by it too keeps the groups
    and lets the aggregate reuse the partitioning. Chunks give one row per
    destination each, and only these are moved for the second minimum.
    """
    best = argmin(rows, ["product", "zone", "pincode", "_db", "_sc"], list(TIE_ORDER))
    return argmin(best, ["product", "zone", "pincode"], list(TIE_ORDER))


def _numbered(sellers: DataFrame, numbers: DataFrame, max_broadcast_rows: int) -> DataFrame:
    """Sellers with the number ``_i`` of their pincode in the zone (a seller without a pincode has one too)."""
    n = numbers.select(F.col("zone").alias("_z"), F.col("pincodeNum").alias("_s"), "_i")
    on = (F.col("zone") == F.col("_z")) & F.col("pincodeNum").eqNullSafe(F.col("_s"))
    return join_small(sellers, n, on, max_broadcast_rows=max_broadcast_rows).drop("_z", "_s")


#: Sellers of a list that are priced side by side, as columns of one generated loop; longer lists are priced as arrays.
SLOTS = 4

#: Bytes of charges that one row holds (a block of destinations).
BLOCK_BYTES = 8 << 20


def _slots(lists: DataFrame) -> DataFrame:
    """Lists of numbered sellers as columns: number, cost (price and margin) and quantity of the first ``SLOTS``.

    ``_mine``: there are no more than these. They come in the order of (buyingPrice, quantity), the order of ties; a list that is shorter has nulls.
    """
    def cost(o):
        b = o["buyingPrice"].cast("double")
        return F.struct(o["buyingPrice"].alias("b"), o["quantity"].alias("q"), o["_i"].alias("i"), (b + F.lit(MARGIN) * b).alias("c"))

    s = lists.select("zone", "product", "_db", (F.size("sellers") <= SLOTS).alias("_mine"),
                     F.array_sort(F.transform("sellers", cost)).alias("_s"))
    return s.select("zone", "product", "_db", "_mine", *[F.get("_s", F.lit(j))[f].alias(f"_{f}{j}") for j in range(SLOTS) for f in "icq"])


def _least_of_slots(x: DataFrame, on_missing: str) -> DataFrame:
    """The least offer of every list (as columns, by ``_slots``) and destination (``_dest``) that met.

    Every expression here is compiled, where functions of arrays are interpreted seller by seller.
    """
    each = range(SLOTS)
    # a seller that isn't there, or doesn't serve the destination, has no price and is passed over
    priced = [round_half_up(F.col(f"_c{j}") + F.get("_dest.charges", F.col(f"_i{j}"))).alias(f"_p{j}") for j in each]
    x = x.select("product", "zone", F.col("_dest.pincode").alias("pincode"), *priced, *[f"_q{j}" for j in each])
    x = x.select("*", F.least(*[F.col(f"_p{j}") for j in each]).alias("finalPrice"))
    first = F.coalesce(*[F.when(F.col(f"_p{j}") == F.col("finalPrice"), F.col(f"_q{j}")) for j in each])
    x = x.select("product", "zone", "pincode", "finalPrice", first.alias("quantity"))
    return x if on_missing == "zero" else x.where(F.col("finalPrice").isNotNull())


def _least_of_arrays(x: DataFrame, on_missing: str) -> DataFrame:
    """The least offer of every list (``sellers``) and destination (``_dest``) that met, for lists of any length."""
    def priced(o):
        b = o["buyingPrice"].cast("double")
        charge = F.get("_dest.charges", o["_i"])
        price = round_half_up(b + F.lit(MARGIN) * b + charge).alias("finalPrice")
        offer = F.struct(price, o["buyingPrice"].alias("buyingPrice"), o["quantity"].alias("quantity"))
        return offer if on_missing == "zero" else F.when(charge.isNotNull(), offer)

    key = ["product", "zone", F.col("_dest.pincode").alias("pincode")]
    best = F.array_min(F.transform("sellers", priced))
    # as a generator the least offer is computed once, where a filter and its fields would each compute it again
    x = (x.select(*key, F.inline(F.array_compact(F.array(best)))) if on_missing == "drop"
         else x.select(*key, best.alias("_w")).select("product", "zone", "pincode", "_w.*"))
    return x.select("product", "zone", "pincode", "finalPrice", "quantity")


def _least_of_lists(lists: DataFrame, charges: DataFrame, pins: DataFrame, numbers: DataFrame, on_missing: str,
                    max_broadcast_rows: int, dest_bucket_rows: int, partitions: int) -> DataFrame:
    """The least offer per (product, zone, pincode) of the lists of numbered sellers of (zone, product, _db):
    product, zone, pincode, finalPrice, quantity.

    A list meets the destinations of its bucket as one array (or a few, of ``BLOCK_BYTES`` at most), which is
    walked; each holds its charges. The least price is taken inside that
    row, so the expansion has exactly the rows of the result, and none of
    them is sorted, aggregated or moved.
    """
    widest = numbers.groupBy("zone").count().agg(F.max("count")).first()[0] or 0
    blocks = -(-dest_bucket_rows * (64 + 8 * widest) // BLOCK_BYTES)
    dests = charges.groupBy("zone", "_db", F.pmod(F.xxhash64("pincode"), F.lit(blocks)).alias("_block")).agg(
        F.collect_list(F.struct("pincode", "charges")).alias("dests")).drop("_block")
    bound = min(max_broadcast_rows, DEFAULT_BROADCAST_BYTES // (64 + 8 * widest))

    def met(rows):
        x = expand_join(rows, dests, ["zone", "_db"], bound, held=pins, partitions=partitions)
        # not a filter of the lists: below their exchange it would make them two, and every list would be made twice
        mine = F.explode(F.when(F.col("_mine"), F.col("dests"))).alias("_dest")
        return x.select(*[c for c in rows.columns if c not in ("_db", "_mine")], mine)

    many = lists.select("zone", "product", "_db", "sellers", (F.size("sellers") > SLOTS).alias("_mine"))
    return _least_of_arrays(met(many), on_missing).unionByName(_least_of_slots(met(_slots(lists)), on_missing))


def min_price_for_zone(offers: DataFrame, pincodes: DataFrame,
                       products: DataFrame | None = None, zone: str | None = None,
                       charge: float = ZONE_CHARGE, distances: DataFrame | None = None,
                       on_missing: str = "zero",
                       max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
                       dest_bucket_rows: int = 2000,
                       sellers: DataFrame | None = None, seller_chunk_rows: int = 2000) -> DataFrame:
    """Least delivered price and winning quantity for every pincode of a zone,
    for all products at once (all zones when ``zone`` is None).

    ``distances=None`` uses the flat ``charge``; otherwise the charge is the
    seller->destination distance (see ``attach_charge``).
    Output: product, zone, pincode, finalPrice, quantity.
    ``sellers`` (distance mode) is a precomputed ``seller_winners`` table,
    e.g. from ``store_seller_winners``; the offers are then not read.

    Distance mode, for pincode and distance tables of any size:

    * sellers of one (zone, product) are co-located by one shuffle of the
      per-seller winners (small) and become one list, which meets every
      destination with its charges: the least price is taken inside that row,
      so the expansion is the result itself, never sorted or aggregated;
    * destinations are split into ``ceil(#pincodes / dest_bucket_rows)``
      buckets and each seller row is copied to every bucket;
    * a key with more than ``seller_chunk_rows`` sellers is dealt by chunks of
      sellers, which are expanded one by one: a minimum per chunk, then one
      over the chunks, so that no task expands more than
      ``seller_chunk_rows * dest_bucket_rows`` of its rows;
    * exact pruning before the expansion: with c_min/c_max the least and
      greatest charge of a seller over the zone, a seller whose price at
      c_min exceeds another seller's price at c_max (a seller present at
      every destination) is strictly worse everywhere and never wins;
    * a destination's charges are one array by seller number
      (``charges_by_seller``), broadcast if proven small, else met in a grid
      of cells; the bounds, and the charges of chunks, come from broadcast
      tables if pincodes and distances are proven small, else from
      ``charge_arrays``, joined to the sellers *before* they are expanded.
    """
    pins = zone_pincodes(pincodes, zone)
    if distances is None:
        # priced before they are expanded, and a zone's pincodes walked as one array, so that an expanded row costs little
        w = zone_winners(offers, products, zone).select(
            "product", "zone", delivered_price("buyingPrice", charge).alias("finalPrice"), "quantity")
        if fits(pins, max_broadcast_rows):
            # as many tasks as there are offers for, where adaptive execution would leave the winners, a small table, in a few
            w = w.repartition(task_count(pins.sparkSession, row_count(offers)))
            # no list is empty: the outer form only spares a filter on them, for which the offers' zones would be looked up first
            x = w.join(F.broadcast(zone_lists(pincodes, zone)), "zone").withColumn("pincode", F.explode_outer("pincodes"))
        else:
            x = expand_join(w, pins, "zone", max_broadcast_rows)
        return x.select("product", "zone", "pincode", "finalPrice", "quantity")
    s = _zone(sellers, zone) if sellers is not None else seller_winners(offers, products, zone)
    buckets = max(1, -(-row_count(pins) // dest_bucket_rows))
    p = pins.withColumn("_db", F.pmod(F.xxhash64("pincode"), F.lit(buckets)).cast("int"))
    key = ["zone", "product", "_db"]
    small = fits(pins, max_broadcast_rows) and fits(distances, max_broadcast_rows)
    # read many times, and as small as the seller pincodes are few: the offers are scanned for them once
    numbers = materialised(seller_numbers(_zone(sellers if sellers is not None else offers, zone)), "zone-numbers")
    numbers = numbers if small else numbers.hint("merge")
    if small:
        s = _prune_dominated(s, pins, distances, on_missing, broadcast_bounds=True)
        s = s.withColumn("_db", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    else:
        # the seller winners are aggregated once: their pincodes, their bounds and the survivors all read them
        winners = materialised(s, "zone-sellers")
        s = winners.withColumn("_db", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
        shared_dir(pins.sparkSession, unique=False)
        arrays = _numbered(charge_arrays(s.select("zone", "pincodeNum", "_db").distinct(), p, distances, on_missing,
                                         max_broadcast_rows), numbers, max_broadcast_rows).checkpoint()
        s = s.join(arrays.drop("entries"), ["zone", "pincodeNum", "_db"], "inner")
        s = (s.withColumn("_lo", delivered_price("buyingPrice", F.col("cmin")))
             .withColumn("_hi", F.when(F.col("full"), delivered_price("buyingPrice", F.col("cmax")))))
    if small:
        s = _numbered(s, numbers, max_broadcast_rows)
    upper = F.min("_hi").over(Window.partitionBy(*key))
    s = s.repartition(*key).withColumn("_u", upper).where(F.col("_u").isNull() | (F.col("_lo") <= F.col("_u")))
    s = s.select("zone", "product", "pincodeNum", "buyingPrice", "quantity", "_db", "_i")
    charges = charges_by_seller(numbers, p, distances, on_missing, max_broadcast_rows)

    def expanded(rows: DataFrame) -> DataFrame:
        if small:
            x = rows.join(F.broadcast(p), ["zone", "_db"], "inner")
            x = attach_charge(x, distances, "pincodeNum", "pincode", on_missing, broadcast=True)
        else:
            x = rows.join(arrays.select("zone", "pincodeNum", "_db", "entries"), ["zone", "pincodeNum", "_db"])
            x = x.repartition(*key, "_sc")
            x = x.select(*[c for c in x.columns if c != "entries"], F.inline("entries"))
        return x.withColumn("finalPrice", delivered_price("buyingPrice", F.col("charge")))

    out = ["product", "zone", "pincode", "finalPrice", "quantity"]
    # the lists are dealt once more, into a stated number of partitions: adaptive execution would merge those of the sellers
    # into a few, and share them out between lists by length (dealt in another order of the key, or the plan drops it)
    dealt = ["product", "zone", "_db"]
    n = task_count(pins.sparkSession, row_count(offers if sellers is None else sellers))

    def least(of):
        return _least_of_lists(of, charges, p, numbers, on_missing, max_broadcast_rows, dest_bucket_rows, n)

    # no key has more sellers than there are seller pincodes
    if small and row_count(numbers) <= seller_chunk_rows:
        return least(_lists(s).repartition(n, *dealt))
    if small:
        few, many = _in_chunks(s, seller_chunk_rows)
        few = _lists(few).repartition(n, *dealt)
    else:
        # both parts read it; stored small, its lists may still be too large to be sent to every task
        lists = materialised(_lists(s), "zone-lists").hint("merge")
        dropped(winners)
        few, many = _lists_in_chunks(lists, seller_chunk_rows)
    return least(few).unionByName(_least(expanded(many)).select(*out))


def attach_destination(offers: DataFrame, requests: DataFrame) -> DataFrame:
    """Offers of each request's (zone, product) with the destination attached.

    Equi-join on (zone, product); a one-row request is the single-pincode case.
    The rows are request x offer pairs: an audit listing, not a step towards a price.
    """
    r = requests.select("request_id", "zone", "product", F.col("dest_pin").alias("destPin"))
    return r.join(offers, ["zone", "product"], "inner")


def price_for_destinations(offers: DataFrame, requests: DataFrame, distances: DataFrame,
                           on_missing: str = "zero") -> DataFrame:
    """Every eligible offer of each request priced with the distance charge.

    An audit listing: a product with R requests and O offers gives R x O rows.
    To find prices only, use ``min_price_for_pins``, which reduces offers per
    seller before destinations are attached.

    Output: request_id, zone, product, pincodeNum, destPincode, buyingPrice,
    quantity, charge, finalPrice.
    """
    x = attach_destination(eligible_offers(offers), requests).withColumnRenamed("destPin", "destPincode")
    x = attach_charge(x, distances, "pincodeNum", "destPincode", on_missing)
    return x.select("request_id", "zone", "product", "pincodeNum", "destPincode",
                    "buyingPrice", "quantity", "charge",
                    delivered_price("buyingPrice", F.col("charge")).alias("finalPrice"))


def min_price_for_pins(offers: DataFrame, requests: DataFrame,
                       products: DataFrame | None = None, charge: float = PIN_CHARGE,
                       distances: DataFrame | None = None,
                       on_missing: str = "zero", sellers: DataFrame | None = None) -> DataFrame:
    """Least delivered price for each (request_id, product, zone, dest_pin).

    No row when the product is unknown or has no eligible offer in the zone.
    Distinct (zone, product, dest_pin) keys are priced once and joined back.
    Output: request_id, product, zone, pincode, price.
    """
    # the winners are already limited to catalogue products; the inner joins
    # below drop requests for unknown products without a second semi join
    req = requests.select("request_id", "product", "zone", "dest_pin")
    if distances is None:
        w = zone_winners(requested_offers(offers, req), products)
        priced = w.select("zone", "product", delivered_price("buyingPrice", charge).alias("price"))
        out = req.join(priced, ["zone", "product"], "inner")
    else:
        keys = req.select("zone", "product", "dest_pin").distinct()
        s = sellers if sellers is not None else seller_winners(requested_offers(offers, req), products)
        x = keys.join(s, ["zone", "product"], "inner")
        x = attach_charge(x, distances, "pincodeNum", "dest_pin", on_missing)
        x = x.withColumn("finalPrice", delivered_price("buyingPrice", F.col("charge")))
        best = x.groupBy("zone", "product", "dest_pin").agg(F.min("finalPrice").alias("price"))
        out = req.join(best, ["zone", "product", "dest_pin"], "inner")
    return out.select("request_id", "product", "zone",
                      F.col("dest_pin").alias("pincode"), "price")


def min_price_for_pin(spark, offers: DataFrame, product: int | str, zone: str, dest_pin: int,
                      products: DataFrame | None = None, charge: float = PIN_CHARGE,
                      distances: DataFrame | None = None) -> DataFrame:
    """Single request convenience: one product, zone and destination.

    Its literals reach the offers' scan as filters, so of offers stored by
    ``write_offers`` only the zone's folder and the row groups that may hold
    the product are read.
    """
    at = zone.strip().upper()
    req = spark.createDataFrame(
        [(0, product, at, dest_pin)],
        f"request_id BIGINT, product {dict(offers.dtypes)['product']}, zone STRING, dest_pin INT")
    own = offers.where((F.col("zone") == F.lit(at)) & (F.col("product") == F.lit(product)))
    return min_price_for_pins(own, req, products, charge, distances).drop("request_id")


def min_price(offers_with_dest: DataFrame, keys=("destPin",), charge: float = PIN_CHARGE) -> DataFrame:
    """Least price per key over offers that already carry their destination."""
    e = eligible_offers(offers_with_dest).withColumn(
        "finalPrice", delivered_price("buyingPrice", charge))
    return e.groupBy(*keys).agg(F.min("finalPrice").alias("price"))


def quote_sellers(offers: DataFrame, distances: DataFrame, on_missing: str = "drop",
                  max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """zone, product, pincodeNum, sellingPrice, lo, place: every seller pincode's least selling price, the least quote
    it can give to another pincode (null if it serves none), and its place by that quote within the product.

    They are dealt by (zone, product) into partitions of a bounded number of offers, so that the places and what
    joins them there need no more memory in a task when there are more offers."""
    # per seller pincode only its least selling price can give the least
    # quote (the charge is the same for all its offers): a hash min suffices
    s = (eligible_offers(offers, "selling")
         .groupBy("zone", "product", "pincodeNum").agg(F.min("sellingPrice").alias("sellingPrice")))
    near = (listed(distances).where(F.col("sourcePincode") != F.col("destPincode"))
            .groupBy(F.col("sourcePincode").alias("pincodeNum")).agg(F.min("distance").alias("_near")))
    s = join_small(s, near, "pincodeNum", "left", max_broadcast_rows)
    least = F.col("_near") if on_missing == "drop" else F.least(F.coalesce("_near", F.lit(0.0)), F.lit(0.0))
    s = s.withColumn("lo", F.col("sellingPrice") + least).drop("_near")
    s = s.repartition(task_count(offers.sparkSession, row_count(offers)), "zone", "product")
    order = Window.partitionBy("zone", "product").orderBy(F.col("lo").asc_nulls_last(), "sellingPrice", "pincodeNum")
    return s.withColumn("place", F.row_number().over(order))


def quote_candidates(destinations: DataFrame, sellers: DataFrame, best: DataFrame | None,
                     first: int | None) -> DataFrame:
    """(destination, seller) pairs that must be looked up in the distance table; all, if ``first`` is None.

    Without ``best``: the ``first`` sellers of each product by their least
    possible quote, and a destination's own seller. With ``best`` (the least
    quote found from those, ``bound``): of the other sellers only those whose
    least possible quote is below it.
    """
    own = F.col("pincodeNum") == F.col("pincode")
    x = destinations.join(sellers, ["zone", "product"], "inner")
    if first is None:
        return x
    if best is None:
        return x.where(own | (F.col("place") <= first))
    x = destinations.join(best, ["zone", "product", "pincode"], "left").join(
        sellers.where(F.col("place") > first), ["zone", "product"], "inner")
    return x.where(~own & F.col("lo").isNotNull() & (F.col("bound").isNull() | (F.col("lo") < F.col("bound"))))


def min_quote_for_pins(offers: DataFrame, destinations: DataFrame, distances: DataFrame,
                       products: DataFrame | None = None, carrier: str = CARRIER,
                       on_missing: str = "drop", first: int = 4,
                       max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Least ``sellingPrice + distance`` for each destination of a list.

    ``destinations`` has (product, zone, pincode) rows, or (product, zone,
    dest_pins ARRAY<INT>) which is exploded. Each destination is priced on
    its own. A seller with no distance entry is skipped (``"drop"``).
    Output: product, zone, pincode, type, price (double, unrounded).

    While the distance table is proven small it is broadcast, and every
    pair is looked up where it lies. Beyond that, threshold search: sellers
    are taken in the order of the least quote they can give (price plus least charge). The ``first`` ones of a product are
    looked up for every destination; the best quote so found is a bound, and
    of the remaining sellers only those that could still be below it are
    looked up. The result is exact for any ``first``.
    """
    d = destinations
    if "dest_pins" in d.columns:
        d = d.select("product", "zone", F.explode("dest_pins").alias("pincode"))
    d = _known(d.select("product", "zone", "pincode").where(F.col("pincode").isNotNull()).distinct(),
               products)
    s = quote_sellers(offers, distances, on_missing, max_broadcast_rows)
    small = fits(distances, max_broadcast_rows)
    if small:  # no row moves for a look-up, so there is nothing to save
        first = None

    def least(pairs: DataFrame) -> DataFrame:
        # only the least price is reported, so a plain min (hash aggregate) suffices
        x = attach_charge(pairs, distances, "pincodeNum", "pincode", on_missing, broadcast=small)
        return x.groupBy("zone", "product", "pincode").agg(F.min(F.col("sellingPrice") + F.col("charge")).alias("bound"))

    best = least(quote_candidates(d, s, None, first))
    if first is None:
        return best.select("product", "zone", "pincode", F.lit(carrier).alias("type"), F.col("bound").alias("price"))
    more = least(quote_candidates(d, s, best, first))
    quotes = best.unionByName(more).groupBy("product", "zone", "pincode").agg(F.min("bound").alias("price"))
    return quotes.select("product", "zone", "pincode", F.lit(carrier).alias("type"), "price")


def top_k_offers(offers: DataFrame, k: int = 3, charge: float = ZONE_CHARGE) -> DataFrame:
    """The k cheapest eligible offers per (zone, product), ranked 1..k."""
    priced = price_offers(offers, charge)
    ranked = top_k(priced, ["zone", "product"], list(TIE_ORDER), k)
    return ranked.select("zone", "product", "rank", "finalPrice", "buyingPrice", "quantity", "pincodeNum")
