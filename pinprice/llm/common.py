"""Helpers shared by the operators: shipping the package, shared folders, words."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pinprice.session import shared_dir

#: Words are runs of characters outside this class (fixed value of the contracts).
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def ship_package(spark: SparkSession) -> None:
    """Make ``pinprice`` importable in the Python workers of every executor.

    The sources go out once per session through ``addPyFile``; module-level
    caches then live as long as a worker process, across tasks.
    """
    sc = spark.sparkContext
    if getattr(sc, "_pinprice_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    folder = tempfile.mkdtemp(prefix="pinprice-src-")  # addPyFile copies it to every executor
    path = os.path.join(folder, "pinprice_src.zip")
    Path(path).write_bytes(buf.getvalue())
    sc.addPyFile(path)
    sc._pinprice_shipped = True


def store(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, "llm", name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches, rows: int = 1024):
    """The same rows in smaller batches, so that few texts are Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as 0."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD_PATTERN), 0)), F.lit(0)).cast("long")


def crc32_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod`` (null id: crc32 of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


__all__ = ["WORD_PATTERN", "crc32_mod", "shared_dir", "ship_package", "slices", "store", "word_count"]
