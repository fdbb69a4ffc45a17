"""The corpus pipeline: quality rules, near-dedup, passage dedup, mixing, byte-level BPE.

Every stage takes the documents its predecessor kept and returns documents;
the last one returns their token ids. ``run`` writes each stage's result to
the shared folder and reads it back for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pinprice.llm import bpe_queue, dart_minhash, line_dedup, quality_rules, source_mixing
from pinprice.llm.common import store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the production policy."""
    return quality_rules.keep_documents(docs, quality_rules.POLICIES[quality_rules.PRODUCTION])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of least id, of each near-duplicate class."""
    return dart_minhash.keep_one(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines and passages that an earlier place holds; n_chars follows the text."""
    out = line_dedup.remove_repeats(docs)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.size("removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return source_mixing.emit(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens and digests of the ids and of the bytes they decode to."""
    return bpe_queue.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                            keep=("doc_id", "lang", "source"), digests=True)


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("passage dedup", passage_dedup), ("mixing", mixing),
          ("byte-level BPE", tokens)]

#: Near-dedup signatures and BPE merges have no SQL; tests compare with a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = store(docs, "pipeline")
    return docs
