"""Per-key argmin and top-k with a total, deterministic order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOW = 2 ** 31


def _both_int(df: DataFrame, fields: Sequence[str]) -> bool:
    types = {f.name: f.dataType for f in df.schema.fields}
    return len(fields) == 2 and all(isinstance(types.get(c), T.IntegerType) for c in fields)


def argmin(df: DataFrame, keys: Sequence[str], order: Sequence[str],
           carry: Sequence[str] = (), not_null: bool = False) -> DataFrame:
    """One row per key: the row with the least ``order`` tuple.

    The tuple is compared field by field (nulls first), so ties on the first
    field fall through to the next one (a total order when the tuple
    identifies the row). Partial aggregation on the map side means a key
    holding a third of all rows costs one row per input partition in the
    exchange, never one oversized task.

    ``min(struct(...))`` plans as a sort aggregate. When the caller
    guarantees two non-null INT fields (``not_null=True``), they are packed
    into one BIGINT (high word signed, low word offset by 2^31) and reduced
    with ``min``, a hash aggregate; unpacking is a shift and a mask.
    """
    fields = list(order) + [c for c in carry if c not in order]
    ks = [F.col(k) for k in keys]
    if not_null and _both_int(df, fields):
        hi, lo = fields
        # OR, not +: the low word of the shifted value is zero, and an addition
        # could be reassociated by the optimizer into an overflowing order
        packed = F.shiftleft(F.col(hi).cast("long"), 32).bitwiseOR(F.col(lo).cast("long") + F.lit(_LOW))
        g = df.groupBy(*keys).agg(F.min(packed).alias("_k"))
        k = F.col("_k")
        return g.select(*ks, F.shiftright(k, 32).cast("int").alias(hi),
                        ((k.bitwiseAND(F.lit(0xFFFFFFFF))) - F.lit(_LOW)).cast("int").alias(lo))
    w = F.min(F.struct(*[F.col(c) for c in fields])).alias("_w")
    return df.groupBy(*keys).agg(w).select(*ks, *[F.col(f"_w.{c}").alias(c) for c in fields])


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int,
          rank_col: str = "rank") -> DataFrame:
    """At most ``k`` rows per key, ranked 1..k by ``order`` (ascending).

    ``row_number() <= k`` plans as a partial WindowGroupLimit before the
    shuffle and a final one after it, so a hot key ships at most k rows per
    input partition.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    w = Window.partitionBy(*keys).orderBy(*cols)
    return (df.withColumn(rank_col, F.row_number().over(w))
            .filter(F.col(rank_col) <= k))


def last_per_key(df: DataFrame, keys: Sequence[str], order_col: str,
                 value_cols: Sequence[str]) -> DataFrame:
    """One row per key: the values of the row with the largest ``order_col``."""
    fields = [order_col] + [c for c in value_cols if c != order_col]
    w = F.max(F.struct(*[F.col(c) for c in fields])).alias("_w")
    return (df.groupBy(*keys).agg(w)
            .select(*[F.col(k) for k in keys], *[F.col(f"_w.{c}").alias(c) for c in fields]))
