"""The composite jobs as SQL table functions, for SQL users.

SQL-bodied table functions over the registered views: the analyzer inlines the
body where a function is called. Arguments stand in equality conditions on
grouping keys only, so a call with literals prunes and pushes its filters into
the scans, and a ``LATERAL`` call over a table of keys becomes an equi-join with
offers that are aggregated once. Nothing is evaluated in Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pinprice.functions.expr import PIN_CHARGE, ZONE_CHARGE
from pinprice.functions.sql import price_sql
from pinprice.operators.joins import DEFAULT_BROADCAST_ROWS, fits


def register_table_functions(spark: SparkSession, offers: DataFrame, pincodes: DataFrame, products: DataFrame,
                             distances: DataFrame, prefix: str = "pinprice_") -> list[str]:
    """Register views ``<prefix>offers`` etc. and the functions

    * ``<prefix>pin_price(product, zone)``: the least delivered price for one pincode (any one, as its charge is flat);
    * ``<prefix>zone_prices(zone)``: every product's least price and its quantity for every pincode of a zone;
    * ``<prefix>distance(source, destination)``: the listed distances of a pair, as ``src_dest`` and distance.

    As in the DataFrame forms, unknown products and products without an
    eligible offer give no row, zones are compared trimmed and in upper case,
    and a pincode that is listed twice counts once.
    """
    for name, df in (("offers", offers), ("pincodes", pincodes), ("products", products), ("distances", distances)):
        df.createOrReplaceTempView(f"{prefix}{name}")
    types = dict(offers.dtypes)
    # buying price in the high word and quantity in the low one: a hash aggregate, as in argmin
    least = "min(shiftleft(CAST(o.buyingPrice AS BIGINT), 32) | (CAST(o.quantity AS BIGINT) + 2147483648L))"
    price, quantity = "CAST(shiftright(x.w, 32) AS INT)", "CAST((x.w & 4294967295L) - 2147483648L AS INT)"
    winners = f"""
        SELECT o.zone, o.product, {least} AS w FROM {prefix}offers o
        WHERE o.buyingPrice IS NOT NULL AND o.quantity > 0
          AND o.product IN (SELECT c.product FROM {prefix}products c)"""
    # a shuffle by zone would put each zone's whole expansion into one task
    hint = "/*+ BROADCAST(d) */ " if fits(pincodes, DEFAULT_BROADCAST_ROWS) else ""
    defs = {
        "pin_price": f"""(p {types['product']}, z STRING)
            RETURNS TABLE (product {types['product']}, zone STRING, price BIGINT)
            RETURN SELECT x.product, x.zone, {price_sql(price, f'{PIN_CHARGE}D')}
            FROM ({winners} GROUP BY o.zone, o.product) x WHERE x.product = p AND x.zone = upper(trim(z))""",
        "zone_prices": f"""(z STRING)
            RETURNS TABLE (product {types['product']}, zone STRING, pincode INT, finalPrice BIGINT, quantity INT)
            RETURN SELECT {hint}y.product, y.zone, d.pincode, y.finalPrice, y.quantity
            FROM (SELECT x.product, x.zone, {price_sql(price, f'{ZONE_CHARGE}D')} AS finalPrice, {quantity} AS quantity
                  FROM ({winners} GROUP BY o.zone, o.product) x) y
            JOIN (SELECT DISTINCT upper(trim(q.zone)) AS zone, q.pincode FROM {prefix}pincodes q
                  WHERE q.pincode IS NOT NULL) d ON d.zone = y.zone WHERE y.zone = upper(trim(z))""",
        "distance": f"""(src INT, dest INT) RETURNS TABLE (src_dest STRING, distance DOUBLE)
            RETURN SELECT concat_ws('_', d.sourcePincode, d.destPincode), d.distance FROM {prefix}distances d
            WHERE d.sourcePincode = src AND d.destPincode = dest""",
    }
    for name, body in defs.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}{body}")
    return [f"{prefix}{name}" for name in defs]


__all__ = ["register_table_functions"]
