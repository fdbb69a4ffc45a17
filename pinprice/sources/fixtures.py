"""Stand-in inputs derived from the driver's TPC-H-like tables.

Each builder only produces rows in the schema a job expects; none of the
price work happens here. Every table grows with the underlying data:

* ``pincodes``          customer locations: nation -> zone (region name), more of them
  the more customers there are, a few listed under two zones;
* ``zoneprices``        one offer per line item, seller location from the supplier;
* ``pincodedistances``  one entry per seller->customer pair seen in an order, some
  without a distance;
* ``productinfos``      the part catalogue;
* ``product_prices``    prior price state per (part, customer pincode) sold;
* ``requests``          one request per event, over the whole catalogue (and some unknown
  products), every zone for either kind.

``FIXTURE_SQL`` holds the same derivations as SQL text for the DuckDB oracle.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pinprice.operators.joins import join_small, row_count, task_count
from pinprice.session import shared_dir
from pinprice.sources.sinks import write_bucketed
from pinprice.sources.tables import write_offers

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
               "lineitem", "events")


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _count(spark: SparkSession, sf_dir: str, name: str, key: str) -> int:
    """One more than the greatest key of a base table (its size, as keys rise from 0)."""
    top = base_table(spark, sf_dir, name).agg(F.max(key).alias("m")).first()["m"]
    return 0 if top is None else int(top) + 1


def pins_per_nation(spark: SparkSession, sf_dir: str) -> int:
    """Pincodes of a nation: they grow with the square root of the customers."""
    return 10 + math.isqrt(_count(spark, sf_dir, "customer", "c_custkey")) // 20


def _pin(nationkey: Column, key: Column, width: int) -> Column:
    # pincode of a location: a run of ``width`` numbers per nation
    return (F.lit(500000) + nationkey * F.lit(width) + key % F.lit(width)).cast("int")


def _zone_of_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    # nation (25 rows) and region (5 rows) have a fixed size at every scale
    n = base_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = base_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey"), F.col("r_name").alias("zone"))


def pincodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = base_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    z, width = _zone_of_nation(spark, sf_dir), pins_per_nation(spark, sf_dir)
    rows = c.join(F.broadcast(z), c.c_nationkey == z.n_nationkey).select(
        _pin(F.col("c_nationkey"), F.col("c_custkey"), width).alias("pincode"), F.col("zone"), "c_custkey")
    # some locations are listed under a second zone as well
    other = F.when(F.col("zone") == "EUROPE", "ASIA").otherwise("EUROPE")
    both = rows.where(F.col("c_custkey") % 97 == 5).select("pincode", other.alias("zone"))
    return rows.select("pincode", "zone").union(both).distinct()


def zoneprices(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = base_table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_returnflag")
    s = base_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    z = _zone_of_nation(spark, sf_dir)
    sz = s.join(F.broadcast(z), s.s_nationkey == z.n_nationkey).select("s_suppkey", "s_nationkey", "zone")
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    buying = F.when((flag == "A") & (line == 1), F.lit(None).cast("int")).otherwise(
        F.floor(F.col("l_extendedprice") / F.lit(100)).cast("int"))
    selling = F.when((flag == "N") & (line == 2), F.lit(None).cast("double")).otherwise(
        F.col("l_extendedprice") / F.lit(100))
    qty = (F.when((line == 7) & (flag == "R"), F.lit(None).cast("int"))
           .when(F.col("l_discount") < F.lit(0.005), F.lit(0))
           .otherwise(F.col("l_quantity").cast("int")))
    width = pins_per_nation(spark, sf_dir)
    # suppliers grow with the data: broadcast only behind a row-count check
    return join_small(li, sz, li.l_suppkey == sz.s_suppkey).select(
        F.col("zone"), F.col("l_partkey").alias("product"),
        _pin(F.col("s_nationkey"), F.col("s_suppkey"), width).alias("pincodeNum"),
        buying.alias("buyingPrice"), selling.alias("sellingPrice"), qty.alias("quantity"))


def _shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part, seller pincode, customer pincode, extendedprice, quantity) per line item.

    Orders meet their customers first, so that line items are moved once, by
    order, into partitions of a bounded number of rows.
    """
    li = base_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    o = base_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = base_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = base_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    width = pins_per_nation(spark, sf_dir)
    dest = join_small(o, c, o.o_custkey == c.c_custkey).select(
        "o_orderkey", _pin(F.col("c_nationkey"), F.col("c_custkey"), width).alias("dest"))
    sold = join_small(li, s, li.l_suppkey == s.s_suppkey).select(
        "l_orderkey", "l_partkey", _pin(F.col("s_nationkey"), F.col("s_suppkey"), width).alias("src"),
        "l_extendedprice", "l_quantity")
    n = task_count(spark, row_count(li))
    j = sold.repartition(n, "l_orderkey").join(dest.repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_partkey", "src", "dest", "l_extendedprice", "l_quantity")


def pincodedistances(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _shipments(spark, sf_dir).select("src", "dest").distinct()
    src, dest = F.col("src"), F.col("dest")
    dist = F.when(src == dest, F.lit(0.0)).when((src * 7 + dest * 3) % 29 == 0, F.lit(None).cast("double")).otherwise(
        ((src * F.lit(31) + dest * F.lit(17)) % F.lit(2000)).cast("double") / F.lit(100.0))
    return pairs.select(src.alias("sourcePincode"), dest.alias("destPincode"), dist.alias("distance"))


def productinfos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product"))


def product_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    # dealt like the buckets that the state is stored in: aggregated and written there without another exchange
    sh = _shipments(spark, sf_dir).repartition(state_buckets(spark), "l_partkey")
    return sh.groupBy(F.col("l_partkey").alias("product"), F.col("dest").alias("pincode")).agg(
        F.min(F.floor(F.col("l_extendedprice") / F.lit(100))).cast("bigint").alias("price"),
        F.min("l_quantity").cast("int").alias("quantity"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base_table(spark, sf_dir, "events").select("event_id")
    i = F.col("event_id")
    parts, pins = _count(spark, sf_dir, "part", "p_partkey"), 25 * pins_per_nation(spark, sf_dir)
    # a fifth of the product range lies beyond the catalogue
    known = parts + parts // 4 + 1
    zonal = i % 199 == 1
    kind = F.when(zonal, F.lit("zone")).otherwise(F.lit("pin"))
    product = F.when(i % 50 == 0, F.lit(None).cast("bigint")).otherwise(((i % known) * 48271) % known)
    zone = (F.when(i % 41 == 0, F.lit(None).cast("string"))
            .when(i % 43 == 0, F.lit("NOWHERE"))
            .when(i % 5 == 0, F.lit("africa"))
            .when(i % 5 == 1, F.lit("ASIA"))
            .when(i % 5 == 2, F.lit("Europe"))
            .when(i % 5 == 3, F.lit("AMERICA"))
            .otherwise(F.lit("MIDDLE EAST")))
    dest = (F.when(i % 37 == 0, F.lit(-1))
            .when(i % 39 == 0, F.lit(None).cast("int"))
            .when(zonal, F.lit(None).cast("int"))
            .otherwise((F.lit(500000) + ((i % pins) * 8191) % pins).cast("int")))
    return e.select(i.alias("request_id"), kind.alias("kind"), product.cast("bigint").alias("product"),
                    zone.alias("zone"), dest.alias("dest_pin"))


BUILDERS = {
    "pincodes": pincodes,
    "zoneprices": zoneprices,
    "pincodedistances": pincodedistances,
    "productinfos": productinfos,
    "product_prices": product_prices,
    "requests": requests,
}


def fixture_views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All stand-in tables as lazy plans over the base tables (nothing runs)."""
    return {name: build(spark, sf_dir) for name, build in BUILDERS.items()}


_STORED: dict[tuple[str, str], dict[str, DataFrame]] = {}
_STATE_TABLE: dict[tuple[str, str], str] = {}

# least number of buckets of the stored price state (bucketed by product)
STATE_BUCKETS = 16


def state_buckets(spark: SparkSession) -> int:
    """Buckets for the price state: at least the session's shuffle partitions,
    since the bucket count is the parallelism of every merge."""
    return max(STATE_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fixture_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The stand-in tables, written once per session to the shared folder
    (``spark.checkpoint.dir``) and read back from there.

    Offers are stored by ``write_offers`` (one folder per zone, the layout of
    per-zone offer collections, clustered by product), so a zone filter prunes
    folders and a product filter row groups. The
    price state is a table bucketed by product, so a merge reads it without
    shuffling it. Later
    calls reuse the stored tables: their lineage is cut, and size checks
    before a broadcast scan a stored table instead of recomputing a join.
    """
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _STORED:
        base = shared_dir(spark, "fixtures")
        out: dict[str, DataFrame] = {}
        for name, df in fixture_views(spark, sf_dir).items():
            path = f"{base}/{name}"
            if name == "product_prices":
                table = f"pinprice_state_{uuid.uuid4().hex[:12]}"
                out[name] = write_bucketed(df, table, path, ("product",), state_buckets(spark))
                _STATE_TABLE[key] = table
                continue
            if name == "zoneprices":
                write_offers(df, path)
            else:
                df.write.mode("overwrite").parquet(path)
            stored = spark.read.schema(df.schema).parquet(path)
            out[name] = stored.select(*df.columns)
        _STORED[key] = out
    return dict(_STORED[key])


def fixture_state_table(spark: SparkSession, sf_dir: str) -> str:
    """Catalog name of the stored (bucketed) prior price state."""
    fixture_tables(spark, sf_dir)
    return _STATE_TABLE[(spark.sparkContext.applicationId, sf_dir.rstrip("/"))]


# Same derivations as SQL text (runs in Spark SQL and DuckDB alike).
_PIN_C = "CAST(500000 + c.c_nationkey * z.width + c.c_custkey % z.width AS INT)"
_PIN_S = "CAST(500000 + s.s_nationkey * z.width + s.s_suppkey % z.width AS INT)"

FIXTURE_SQL = {
    "sizes": """
SELECT 10 + CAST(FLOOR(FLOOR(SQRT(CAST(c.n AS DOUBLE))) / 20) AS BIGINT) AS width,
  p.n + CAST(FLOOR(p.n / 4) AS BIGINT) + 1 AS known
FROM (SELECT COALESCE(MAX(c_custkey) + 1, 0) AS n FROM customer) c,
     (SELECT COALESCE(MAX(p_partkey) + 1, 0) AS n FROM part) p""",
    "pincodes": f"""
SELECT {_PIN_C} AS pincode, r.r_name AS zone
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey CROSS JOIN sizes z
UNION
SELECT {_PIN_C} AS pincode, CASE WHEN r.r_name = 'EUROPE' THEN 'ASIA' ELSE 'EUROPE' END AS zone
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey CROSS JOIN sizes z WHERE c.c_custkey % 97 = 5""",
    "zoneprices": f"""
SELECT r.r_name AS zone, l.l_partkey AS product, {_PIN_S} AS pincodeNum,
  CASE WHEN l.l_returnflag = 'A' AND l.l_linenumber = 1 THEN NULL
       ELSE CAST(FLOOR(l.l_extendedprice / 100) AS INT) END AS buyingPrice,
  CASE WHEN l.l_returnflag = 'N' AND l.l_linenumber = 2 THEN NULL
       ELSE l.l_extendedprice / 100 END AS sellingPrice,
  CASE WHEN l.l_linenumber = 7 AND l.l_returnflag = 'R' THEN NULL
       WHEN l.l_discount < 0.005 THEN 0 ELSE CAST(l.l_quantity AS INT) END AS quantity
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
CROSS JOIN sizes z""",
    "shipments": f"""
SELECT l.l_partkey AS l_partkey, {_PIN_S} AS src, {_PIN_C} AS dest,
  l.l_extendedprice AS l_extendedprice, l.l_quantity AS l_quantity
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
CROSS JOIN sizes z""",
    "pincodedistances": """
SELECT src AS sourcePincode, dest AS destPincode,
  CASE WHEN src = dest THEN CAST(0 AS DOUBLE) WHEN (src * 7 + dest * 3) % 29 = 0 THEN NULL
       ELSE CAST((src * 31 + dest * 17) % 2000 AS DOUBLE) / CAST(100 AS DOUBLE) END AS distance
FROM (SELECT DISTINCT src, dest FROM shipments) p""",
    "productinfos": "SELECT p_partkey AS product FROM part",
    "product_prices": """
SELECT l_partkey AS product, dest AS pincode,
  CAST(MIN(FLOOR(l_extendedprice / 100)) AS BIGINT) AS price, CAST(MIN(l_quantity) AS INT) AS quantity
FROM shipments GROUP BY l_partkey, dest""",
    "requests": """
SELECT event_id AS request_id,
  CASE WHEN event_id % 199 = 1 THEN 'zone' ELSE 'pin' END AS kind,
  CAST(CASE WHEN event_id % 50 = 0 THEN NULL ELSE ((event_id % z.known) * 48271) % z.known END AS BIGINT) AS product,
  CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 43 = 0 THEN 'NOWHERE'
       WHEN event_id % 5 = 0 THEN 'africa' WHEN event_id % 5 = 1 THEN 'ASIA' WHEN event_id % 5 = 2 THEN 'Europe'
       WHEN event_id % 5 = 3 THEN 'AMERICA' ELSE 'MIDDLE EAST' END AS zone,
  CASE WHEN event_id % 37 = 0 THEN -1 WHEN event_id % 39 = 0 THEN NULL
       WHEN event_id % 199 = 1 THEN NULL
       ELSE CAST(500000 + ((event_id % (25 * z.width)) * 8191) % (25 * z.width) AS INT) END AS dest_pin
FROM events CROSS JOIN sizes z""",
}


def fixture_cte() -> str:
    """``WITH`` clause defining every stand-in view, for oracle SQL."""
    parts = [f"{name} AS ({sql.strip()})" for name, sql in FIXTURE_SQL.items()]
    return "WITH " + ",\n".join(parts) + "\n"
