"""Join helpers with explicit size checks and skew handling.

* ``fits`` proves a bound in rows and in bytes with an exact count (partial
  counts summed, no row moves) before anything is broadcast.
* ``join_small`` broadcasts the small side only behind that check and falls
  back to a shuffle join (with adaptive skew splitting) beyond it.
* ``expand_join`` joins on a key with very few distinct values (a zone):
  a plain shuffle there would put each zone into one task, so beyond the
  broadcast bound both sides are hashed into a grid of cells and each pair
  of rows meets in exactly one cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Row bound under which a dimension is broadcast. Dimensions here are
# pincodes (a few tens of thousands in a real postal system), zones, and the
# distance table while it is small (it can reach pincodes^2 rows).
DEFAULT_BROADCAST_ROWS = 2_000_000
DEFAULT_BROADCAST_BYTES = 256 << 20


def row_count(df: DataFrame) -> int:
    """Exact row count. Partial counts are summed, so no row moves between
    tasks; on a stored Parquet table only row-group metadata is read.

    (``df.limit(n).count()`` is not used for this: it plans as a local limit
    followed by a single-partition exchange, which can move up to n rows
    per input partition into one task.)
    """
    return df.count()


def row_bytes(df: DataFrame) -> int:
    """Bytes of a row in memory: a header, and 8 bytes for a number or 40 for anything longer."""
    return 16 + sum(8 if isinstance(f.dataType, T.NumericType | T.BooleanType | T.DatetimeType) else 40
                    for f in df.schema.fields)


def fits(df: DataFrame, max_rows: int, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> bool:
    """True when ``df`` is proven to stay within both bounds; a bound of 0 rows never broadcasts."""
    if max_rows <= 0:
        return False
    return row_count(df) <= min(max_rows, max_bytes // row_bytes(df))


ROWS_PER_TASK = 500_000


def task_count(spark: SparkSession, rows: int, rows_per_task: int = ROWS_PER_TASK) -> int:
    """Partitions for an exchange of ``rows``: at least the session's, and enough that one holds about ``rows_per_task``.

    An exchange of a stated number is not coalesced, so the memory of a task
    stays the same however many rows there are, and its sorts do not spill.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_task))


def join_small(big: DataFrame, small: DataFrame, on: str | Sequence[str] | Column,
               how: str = "inner",
               max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Join ``big`` to ``small``; broadcast ``small`` only if its size is proven."""
    if fits(small, max_broadcast_rows):
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)


def _cell(df: DataFrame, n: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(n)).cast("int")


def grid_join(left: DataFrame, right: DataFrame, on: Sequence[str],
              left_cells: int, right_cells: int, partitions: int | None = None) -> DataFrame:
    """Exact inner equi-join spread over ``left_cells * right_cells`` cells.

    Each left row is hashed to a row of the grid and copied to every column;
    each right row is hashed to a column and copied to every row. A matching
    pair therefore meets in exactly one cell, so no pair is lost or doubled,
    and one hot key is split over the whole grid instead of one task.
    ``partitions`` states how many tasks the cells are dealt to.
    """
    on = list(on)
    lg = (left.withColumn("_gr", _cell(left, left_cells))
          .withColumn("_gc", F.explode(F.sequence(F.lit(0), F.lit(right_cells - 1)))))
    rg = (right.withColumn("_gc", _cell(right, right_cells))
          .withColumn("_gr", F.explode(F.sequence(F.lit(0), F.lit(left_cells - 1)))))
    cell = on + ["_gr", "_gc"]
    if partitions is not None:
        lg, rg = lg.repartition(partitions, *cell), rg.repartition(partitions, *cell)
    return lg.join(rg, cell, "inner").drop("_gr", "_gc")


def expand_join(big: DataFrame, small: DataFrame, on: str | Sequence[str],
                max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
                left_cells: int = 64, held: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """Inner join on a low-cardinality key (e.g. zone) that multiplies rows.

    Broadcast when ``small`` is proven small (the big side is not shuffled at
    all); otherwise ``grid_join``, never a plain shuffle on the few keys. The
    grid copies the big side only ``ceil(#small / max_broadcast_rows)`` times
    (so one cell holds about a broadcast's worth of the small side) and
    spreads it over ``left_cells`` row buckets. ``held``: the rows that
    ``small`` holds as arrays, which are then counted in its place;
    ``partitions``: see ``grid_join``.
    """
    keys = [on] if isinstance(on, str) else list(on)
    counted = small if held is None else held
    n = row_count(counted)
    bound = min(max_broadcast_rows, DEFAULT_BROADCAST_BYTES // row_bytes(counted))
    if n <= bound:
        return big.join(F.broadcast(small), keys, "inner")
    right_cells = max(1, -(-n // (bound or DEFAULT_BROADCAST_ROWS)))
    return grid_join(big, small, keys, left_cells, right_cells, partitions)
