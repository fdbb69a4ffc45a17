"""Price requests arriving as a stream of files.

Each micro-batch is priced with the batch job (``price_requests``) inside
``foreachBatch``; the result of batch ``n`` is written to its own folder in
overwrite mode, so a replayed batch (after a failure) rewrites the same
rows instead of adding duplicates. The job is stateless: every request is
priced on its own, so no watermark or state store is needed.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pinprice import schemas
from pinprice.operators.aggregate import last_per_key
from pinprice.plans.requests import OUTPUT, price_requests
from pinprice.sources.sinks import merge_values

KEYS, VALUES = ["product", "pincode"], ["price", "quantity"]


def _requests(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None, products: DataFrame | None) -> DataFrame:
    schema = schemas.REQUESTS
    if products is not None:  # the product key has the catalogue's type
        schema = T.StructType([products.schema[f.name] if f.name == "product" else f for f in schema.fields])
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(source_dir)


def _start(stream: DataFrame, handle, checkpoint_dir: str, available_now: bool) -> object:
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def _price_batch(batch: DataFrame, offers: DataFrame, pincodes: DataFrame,
                 products: DataFrame | None, distances: DataFrame | None,
                 winners: DataFrame | None, options: dict,
                 sellers: DataFrame | None = None) -> DataFrame:
    if winners is not None and distances is None:
        return price_requests(batch, offers, pincodes, products, winners=winners, **options)
    if sellers is not None and distances is not None:
        return price_requests(batch, offers, pincodes, products, distances=distances,
                              sellers=sellers, **options)
    keys = batch.select(F.upper(F.trim("zone")).alias("zone"), "product").distinct()
    batch_offers = offers.join(keys, ["zone", "product"], "left_semi")
    return price_requests(batch, batch_offers, pincodes, products, distances=distances, **options)


def stream_price_requests(spark: SparkSession, source_dir: str, output_dir: str,
                          checkpoint_dir: str, offers: DataFrame, pincodes: DataFrame,
                          products: DataFrame | None = None, distances: DataFrame | None = None,
                          max_files_per_trigger: int | None = None, available_now: bool = True,
                          winners: DataFrame | None = None, sellers: DataFrame | None = None,
                          **options) -> object:
    """Start the stream; returns the ``StreamingQuery``.

    With ``winners`` (a stored ``zone_winners`` table, flat charge) or
    ``sellers`` (a stored ``seller_winners`` table, distance charge) each
    batch only joins its requests to it. Without them the offers are
    narrowed to the batch's (zone, product) keys before aggregating.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        res = _price_batch(batch, offers, pincodes, products, distances, winners, options, sellers)
        res.write.mode("overwrite").parquet(f"{output_dir.rstrip('/')}/batch_id={batch_id}")

    return _start(_requests(spark, source_dir, max_files_per_trigger, products), handle, checkpoint_dir, available_now)


def read_stream_results(spark: SparkSession, output_dir: str) -> DataFrame:
    """All priced rows written so far (every batch folder)."""
    return spark.read.parquet(output_dir).select(*OUTPUT)


def _stream_id(spark: SparkSession, checkpoint_dir: str) -> str:
    """The running query's id, which its checkpoint keeps: a new checkpoint is another stream."""
    own = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
    return own or hashlib.md5(checkpoint_dir.encode()).hexdigest()


def write_updates(updates: DataFrame, updates_dir: str, stream: str, batch: int) -> None:
    """Write a batch's price updates (product, pincode, price, quantity, seq), the newest per key.

    Plain Parquet, one folder per stream and batch, so a repeated batch
    replaces its own rows only, and what a batch writes follows the batch.
    """
    newest = last_per_key(updates, KEYS, "seq", VALUES).select(*KEYS, *VALUES, "seq")
    newest.write.mode("overwrite").parquet(f"{updates_dir.rstrip('/')}/stream={stream}/batch={batch}")


def read_updates(spark: SparkSession, updates_dir: str) -> DataFrame:
    """All updates that any stream has written so far."""
    return spark.read.parquet(updates_dir).select(*KEYS, *VALUES, "seq")


def current_prices(state: DataFrame, updates: DataFrame) -> DataFrame:
    """The state with the streams' updates: per product and pincode the entry of greatest ``seq``.

    An entry of the state without a ``seq`` is older than any update. Applying
    updates that the state holds already changes nothing, so no list of
    applied batches is kept: a snapshot is the ordinary job
    ``merge_into_table(..., order_col="seq")`` into a new table version, and
    streams that go on write updates for that version as for the one before.
    """
    return merge_values(state, updates, KEYS, VALUES, order_col="seq")


def stream_merge_prices(spark: SparkSession, source_dir: str, updates_dir: str, checkpoint_dir: str,
                        offers: DataFrame, pincodes: DataFrame, products: DataFrame | None = None,
                        distances: DataFrame | None = None, run: int = 0, max_files_per_trigger: int | None = None,
                        available_now: bool = True, winners: DataFrame | None = None,
                        sellers: DataFrame | None = None, **options) -> object:
    """Price each micro-batch of requests and write its prices as updates of the price state.

    ``current_prices(state, read_updates(spark, updates_dir))`` gives the
    state with all batches: per product and pincode the newest request wins,
    by ``run`` (which rises from one request table to the next) and request
    id, whatever the order of batches. A repeated batch writes the same
    updates again.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        res = _price_batch(batch, offers, pincodes, products, distances, winners, options, sellers)
        seq = F.struct(F.lit(run).cast("bigint").alias("run"), F.col("request_id"))
        upd = res.select("product", "pincode", "price", "quantity", seq.alias("seq"))
        write_updates(upd, updates_dir, _stream_id(spark, checkpoint_dir), batch_id)

    return _start(_requests(spark, source_dir, max_files_per_trigger, products), handle, checkpoint_dir, available_now)
