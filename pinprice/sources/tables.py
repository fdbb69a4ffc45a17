"""Reading tables: one resolver for every collection, zone partitions,
document-form offers.

Any Spark data source can be passed through ``fmt``/``options`` (Parquet by
default); filters and column selections written after the read reach the
scan as ``PushedFilters`` / ``PartitionFilters`` / ``ReadSchema``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pinprice import schemas
from pinprice.functions.expr import normalize_zone
from pinprice.operators.aggregate import top_k
from pinprice.operators.joins import row_count, task_count


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               fmt: str = "parquet", options: dict[str, str] | None = None,
               overrides: dict[str, str] | None = None) -> DataFrame:
    """Load one table. ``options`` are the base options (of a store, say); ``overrides`` of this read win."""
    reader = spark.read.format(fmt).options(**{**(options or {}), **(overrides or {})})
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def match(df: DataFrame, **equals) -> DataFrame:
    """Equality filter on typed literals (never spliced into query text)."""
    cond: Column | None = None
    for k, v in equals.items():
        c = F.col(k).isNull() if v is None else (F.col(k) == F.lit(v))
        cond = c if cond is None else cond & c
    return df if cond is None else df.where(cond)


def fetch_by_id(table: DataFrame, ids: DataFrame, key: str, order: list[str],
                limit: int = 1) -> DataFrame:
    """The rows of ``table`` whose ``key`` is in ``ids``, at most ``limit`` per
    key, first in ``order`` (ascending, nulls first) so the pick is stable.

    Set form of fetching one document by id and showing its first row: the
    ids are a DataFrame (semi join), so any number of keys costs one job.
    The ids are dealt into a stated number of partitions, and the rows meet
    them there: a task ranks a bounded number of rows, however many there are.
    """
    n = task_count(table.sparkSession, row_count(table))
    rows = table.join(ids.select(key).repartition(n, key).distinct(), key, "left_semi")
    return top_k(rows, [key], order, limit).drop("rank")


def write_offers(offers: DataFrame, path: str, mode: str = "overwrite", products: int = 1_000_000,
                 options: dict[str, str] | None = None) -> None:
    """Store offers for key matches: one folder per zone, inside it files that follow the product.

    Reading a zone prunes every other folder; a product's rows lie together,
    so its row groups are found by their extremes, and a Parquet bloom filter
    on the product (sized for ``products`` distinct ones a row group) rules
    out the others that merely span it. The range partitioning goes on beyond
    the product, so one with a third of all offers is dealt to many tasks.
    """
    bloom = {"parquet.bloom.filter.enabled#product": "true",
             "parquet.bloom.filter.expected.ndv#product": str(products),
             "parquet.bloom.filter.adaptive.enabled": "true"}
    order = [c for c in ("zone", "product", "pincodeNum", "buyingPrice", "sellingPrice", "quantity") if c in offers.columns]
    laid = offers.withColumn("zone", normalize_zone("zone")).repartitionByRange(*order).sortWithinPartitions(*order)
    laid.write.mode(mode).options(**{**bloom, **(options or {})}).partitionBy("zone").parquet(path)


def read_offers(spark: SparkSession, path: str, zone: str | None = None,
                product: int | str | None = None) -> DataFrame:
    """Offers of one zone (partition pruning) and optionally one product
    (pushed-down filter); all zones when ``zone`` is None."""
    df = spark.read.parquet(path).select(*schemas.OFFERS.fieldNames())
    if zone is not None:
        df = df.where(F.col("zone") == F.lit(zone.strip().upper()))
    if product is not None:
        df = df.where(F.col("product") == F.lit(product))
    return df


def offers_from_documents(docs: DataFrame) -> DataFrame:
    """Flatten document-form offers (``leastPrice`` struct) to the flat schema.

    A null ``leastPrice`` gives null fields, so such an offer is never eligible.
    """
    return docs.select(
        F.col("zone"), F.col("product"),
        F.col("leastPrice.pincodeNum").alias("pincodeNum"),
        F.col("leastPrice.buyingPrice").alias("buyingPrice"),
        F.col("leastPrice.sellingPrice").alias("sellingPrice"),
        F.col("leastPrice.quantity").alias("quantity"),
    )


def to_documents(offers: DataFrame) -> DataFrame:
    """Flat offers to document form; an all-null value becomes a null struct."""
    fields = ["pincodeNum", "buyingPrice", "sellingPrice", "quantity"]
    all_null = None
    for f in fields:
        c = F.col(f).isNull()
        all_null = c if all_null is None else all_null & c
    value = F.when(~all_null, F.struct(*[F.col(f) for f in fields]))
    return offers.select("zone", "product", value.alias("leastPrice"))
