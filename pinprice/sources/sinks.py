"""Sinks: change sets, whole-value merge, change counts, key-value overwrite.

Parquet has no in-place update. A merge either produces a new table version in
a fresh folder (``merge_into_table``), or rewrites just the hash partitions that
hold an updated key (``merge_parts``).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from pinprice.functions.expr import price_path
from pinprice.operators.aggregate import argmin, last_per_key
from pinprice.session import co_located_joins, streamed_groups


def price_updates(result: DataFrame, price_col: str = "finalPrice",
                  quantity_col: str | None = "quantity", unique: bool = False, grouped: bool = False) -> DataFrame:
    """Flat change set: product, path (``prices.<pincode>``), pincode, price, quantity.

    One row per (product, pincode): a pincode priced in several zones keeps its
    least (price, quantity), as one entry is written per pincode. ``unique=True``
    states that ``result`` holds every (product, pincode) once already, as
    ``min_entry_for_pincodes`` gives it; nothing is then aggregated. Entries in
    groups (``pincodes``, ``paths``) hold each of them once and are walked;
    ``grouped=True`` leaves them as groups, for ``price_map``.
    """
    q = F.col(quantity_col).cast("int") if quantity_col else F.lit(None).cast("int")
    if "pincodes" in result.columns:
        groups = result.select("product", "paths", "pincodes", F.col(price_col).cast("bigint").alias("price"), q.alias("quantity"))
        if grouped:
            return groups
        each = groups.select("product", "paths", F.posexplode("pincodes").alias("_at", "pincode"), "price", "quantity")
        return each.select("product", F.get("paths", F.col("_at")).alias("path"), "pincode", "price", "quantity")
    flat = result.select("product", "pincode", F.col(price_col).cast("bigint").alias("price"), q.alias("quantity"))
    least = flat if unique else argmin(flat, ["product", "pincode"], ["price", "quantity"])
    return least.select("product", price_path("pincode").alias("path"), "pincode", "price", "quantity")


def price_map(updates: DataFrame) -> DataFrame:
    """Document view: product -> MAP<pincode, STRUCT<price, quantity>>.

    One entry per pincode must hold already (``map_from_entries`` rejects
    duplicate keys); the group size is bounded by the pincode dimension.
    Updates that come product by product are folded as they pass, neither
    sorted nor hashed (``streamed_groups``). Entries in groups
    (``pincodes`` of one price and quantity) are folded group by group.
    """
    streamed_groups(updates.sparkSession)
    if "pincodes" in updates.columns:
        group = F.struct("pincodes", F.struct("price", "quantity").alias("value"))
        docs = updates.groupBy("product").agg(F.collect_list(group).alias("g"))
        values = F.transform("g", lambda x: F.array_repeat(x["value"], F.size(x["pincodes"])))
        return docs.select("product", F.map_from_arrays(F.flatten("g.pincodes"), F.flatten(values)).alias("prices"))
    entry = F.struct(F.col("pincode").alias("key"),
                     F.struct("price", "quantity").alias("value"))
    return updates.groupBy("product").agg(F.map_from_entries(F.collect_list(entry)).alias("prices"))


def _prepare(updates: DataFrame, keys: Sequence[str], value_cols: Sequence[str],
             products: DataFrame | None, order_col: str | None, unique: bool = False) -> DataFrame:
    u = updates
    if unique:
        u = u.select(*keys, *value_cols, *([order_col] if order_col else []))
    elif order_col is not None:
        u = last_per_key(u, keys, order_col, value_cols)
        u = u.select(*keys, *value_cols, order_col)
    else:
        # one update per key, as the join below must not multiply the state: the least value tuple
        u = argmin(u.select(*keys, *value_cols), keys, value_cols)
    if products is not None:
        # matched-only: updates for products missing from the catalogue are dropped
        u = u.join(products.select("product"), "product", "left_semi")
    return u


def _meet(state: DataFrame, updates: DataFrame, keys: Sequence[str], value_cols: Sequence[str],
          products: DataFrame | None, order_col: str | None, unique: bool, spread: tuple[str, int] | None,
          how: str, held: bool = False) -> tuple[DataFrame, Column, Column]:
    """State and updates side by side (``_new_`` columns): (rows, the update applies, it changes the entry).

    ``held``: the state's rows of a bucket are held in memory, and the updates pass them unsorted.
    """
    u = _prepare(updates, keys, value_cols, products, order_col, unique)
    if spread is not None:  # the partitioning of the stored state, so that it isn't shuffled
        u = u.repartition(spread[1], spread[0])
    carry = [*value_cols, *([order_col] if order_col else [])]
    st_cols = [F.col(c) for c in (*keys, *value_cols)]
    if order_col:
        seq = F.col(order_col) if order_col in state.columns else F.lit(None).cast(
            dict(u.dtypes)[order_col])
        st_cols.append(seq.alias(order_col))
    st = state.select(*st_cols, F.lit(True).alias("_had"))
    u = u.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in carry], F.lit(True).alias("_hit"))
    rows = (st.hint("shuffle_hash") if held else st).join(u, list(keys), how)
    take = F.col("_hit").isNotNull()
    if order_col:
        take = take & (F.col(order_col).isNull() | (F.col(f"_new_{order_col}") >= F.col(order_col)))
    same = F.col("_had").isNotNull()
    for c in value_cols:
        same = same & F.col(c).eqNullSafe(F.col(f"_new_{c}"))
    return rows, take, take & ~same


def merge_values(state: DataFrame, updates: DataFrame, keys: Sequence[str] = ("product", "pincode"),
                 value_cols: Sequence[str] = ("price", "quantity"),
                 products: DataFrame | None = None, order_col: str | None = None, unique: bool = False,
                 spread: tuple[str, int] | None = None, changed_col: str | None = None,
                 held: bool = False) -> DataFrame:
    """Replace whole values by key; keep every untouched key.

    All value columns of an updated key come from the update together (a
    null in the update replaces the old value; no field-by-field coalesce).
    Several updates of one key count as one: the newest by ``order_col``, or
    without it the least tuple of ``value_cols``. ``unique=True`` states that
    no key is updated twice, and nothing is then aggregated.

    With ``order_col`` (a sequence number such as a request id) the newest
    update per key wins, also against the state: the result keeps
    ``order_col`` and a key is only replaced by an update at least as new
    as the value it holds, so merging batches in any order, or a batch
    twice, gives the same table.

    ``spread`` = (column, buckets) is how the stored state is bucketed: the
    updates are dealt the same way and the state is not shuffled. (Updates
    that come out of a plan with this partitioning need no ``spread``.)
    ``changed_col`` adds a flag: the entry is new or its value differs
    (null-safe) from the one before. ``held=True`` keeps the state's rows of
    a bucket in memory, so that more updates than entries are never sorted.
    """
    keys, value_cols = list(keys), list(value_cols)
    m, take, changed = _meet(state, updates, keys, value_cols, products, order_col, unique, spread, "full_outer", held)
    carry = value_cols + ([order_col] if order_col else [])
    flag = [] if changed_col is None else [changed.alias(changed_col)]
    return m.select(*keys, *[F.when(take, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in carry], *flag)


def modified_products(state: DataFrame, updates: DataFrame, keys: Sequence[str] = ("product", "pincode"),
                      value_cols: Sequence[str] = ("price", "quantity"),
                      products: DataFrame | None = None, order_col: str | None = None, unique: bool = False,
                      group_col: str = "product", spread: tuple[str, int] | None = None,
                      held: bool = False) -> DataFrame:
    """Modified count per document: ``group_col``, ``updated`` (entries that were
    written) and ``modified`` (those that are new or differ, null-safe).

    A document without an update has no row; with ``order_col`` an update
    older than the stored value is not written and does not count.
    """
    keys, value_cols = list(keys), list(value_cols)
    j, take, changed = _meet(state, updates, keys, value_cols, products, order_col, unique, spread, "right", held)
    return j.groupBy(group_col).agg(F.count(F.when(take, True)).alias("updated"),
                                    F.count(F.when(changed, True)).alias("modified"))


def changed_count(state: DataFrame, updates: DataFrame, keys: Sequence[str] = ("product", "pincode"),
                  value_cols: Sequence[str] = ("price", "quantity"),
                  products: DataFrame | None = None, order_col: str | None = None, unique: bool = False,
                  group_col: str = "product", spread: tuple[str, int] | None = None) -> DataFrame:
    """Number of ``group_col`` values (documents) a merge would modify.

    A key counts as modified when it is new or any value differs (null-safe);
    with ``order_col`` present in the state, an update older than the stored
    value is not applied and does not count. Output: one row, ``n`` BIGINT.
    """
    each = modified_products(state, updates, keys, value_cols, products, order_col, unique, group_col, spread)
    return each.where("modified > 0").agg(F.count(F.lit(1)).alias("n"))


def assert_unique(df: DataFrame, key: str) -> None:
    """Raise when a key occurs twice (one bounded distributed job)."""
    dup = df.groupBy(key).count().where(F.col("count") > 1).limit(1).collect()
    if dup:
        raise ValueError(f"duplicate key {dup[0][key]!r} in column {key!r}")


def write_kv(kv: DataFrame, path: str, key: str = "src_dest", fmt: str = "parquet",
             options: dict[str, str] | None = None, mode: str = "overwrite",
             check_unique: bool = True) -> None:
    """Replace a key-value table (all rows, keyed by ``key``).

    Any Spark data source can be named in ``fmt``; the ``options`` (e.g. a
    table name and key column for a key-value store connector) pass through.
    """
    if check_unique:
        assert_unique(kv, key)
    kv.write.mode(mode).format(fmt).options(**(options or {})).save(path)


def read_kv(spark: SparkSession, path: str, fmt: str = "parquet",
            options: dict[str, str] | None = None) -> DataFrame:
    return spark.read.format(fmt).options(**(options or {})).load(path)


def replace_kv(kv: DataFrame, table: str, path: str, key: str = "src_dest", buckets: int = 16,
               check_unique: bool = True) -> DataFrame:
    """Replace a key-value table that is stored for keyed access: bucketed and sorted by its key.

    Every call writes a fresh folder under ``path`` and then points the
    catalog's table at it, so a job that fails leaves the table as it was, and
    readers of the old folder finish undisturbed (removing old folders is the
    owner's business). A lookup by literal keys reads only their buckets
    (``lookup_keys``); one by a table of keys joins without shuffling this side.
    """
    spark = kv.sparkSession
    if check_unique:
        assert_unique(kv, key)
    fresh = f"{path.rstrip('/')}/{uuid.uuid4().hex}"
    new = f"{table}_{uuid.uuid4().hex[:12]}"
    # one task per bucket writes its file, so a bucket is one sorted run
    (kv.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key)
     .option("path", fresh).saveAsTable(new))
    if spark.catalog.tableExists(table):
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{fresh}'")
        spark.catalog.refreshTable(table)
        spark.sql(f"DROP TABLE {new}")  # an external table: the folder stays
    else:
        spark.sql(f"ALTER TABLE {new} RENAME TO {table}")
    return spark.table(table)


def lookup_keys(spark: SparkSession, table: str, keys: Sequence[str], key: str = "src_dest") -> DataFrame:
    """The entries of a few literal keys; only the buckets that can hold them are read."""
    return spark.table(table).where(F.col(key).isin(list(keys)))


def write_bucketed(df: DataFrame, table: str, path: str, keys: Sequence[str] = ("product", "pincode"),
                   buckets: int = 16, mode: str = "errorifexists") -> DataFrame:
    """Store a keyed table bucketed by ``keys`` (an external table at ``path``).

    A later join or merge on these keys, or on more than these, reads the
    table without a shuffle; only the other side is shuffled into the same
    buckets (seen on Spark 4.1 with bucket counts below and above the shuffle
    partitions). The bucket count is the merge's parallelism, so size it to
    the cluster.
    """
    (df.write.mode(mode).format("parquet").bucketBy(buckets, *keys)
     .option("path", path).saveAsTable(table))
    return df.sparkSession.table(table)


def merge_into_table(spark: SparkSession, state_table: str, updates: DataFrame, out_table: str,
                     out_path: str, keys: Sequence[str] = ("product", "pincode"),
                     value_cols: Sequence[str] = ("price", "quantity"),
                     products: DataFrame | None = None, order_col: str | None = None,
                     buckets: int = 16, mode: str = "errorifexists", bucket_by: str = "product",
                     unique: bool = False, dealt: bool = False) -> tuple[DataFrame, int]:
    """Merge ``updates`` into a state table bucketed by ``bucket_by`` and store
    the result as a new bucketed version (the old version stays readable).

    Returns (new version, number of ``bucket_by`` values whose entries
    changed). The state is read bucket by bucket without an exchange, the
    merged rows come out in the same buckets, so the write needs no shuffle,
    and the count is observed on the rows being written: state and updates
    meet once. Each document lies in one bucket, so its first changed row is
    found there by a window. ``dealt=True``: the updates
    come partitioned by ``bucket_by`` into ``buckets`` already, and may be far
    more than the state's entries. They pass the state's bucket, held in
    memory, twice: once for the count, once for the version, as counting the
    rows being written would sort and move them all; neither pass sorts,
    spills or moves them.
    """
    co_located_joins(spark)
    if dealt:
        state = spark.table(state_table)
        n = modified_products(state, updates, keys, value_cols, products, order_col, unique, bucket_by, None, True)
        modified = n.where("modified > 0").count()
        merged = merge_values(state, updates, keys, value_cols, products, order_col, unique, None, None, True)
        with _files_open_at_once(spark, 4):  # a task's rows are of one bucket
            write_bucketed(merged, out_table, out_path, (bucket_by,), buckets, mode)
        return spark.table(out_table), modified
    merged = merge_values(spark.table(state_table), updates, keys, value_cols, products, order_col, unique,
                          (bucket_by, buckets), "_changed")
    seen = Observation(f"merge {out_table}")
    out, cols = _observe_modified(merged, bucket_by, seen)
    write_bucketed(out.select(*cols), out_table, out_path, (bucket_by,), buckets, mode)
    return spark.table(out_table), int(seen.get["modified"] or 0)


@contextmanager
def _files_open_at_once(spark: SparkSession, n: int) -> Iterator[None]:
    """Write up to ``n`` folders or buckets of a task side by side; its rows are sorted by them only beyond that."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _observe_modified(merged: DataFrame, group_col: str, seen: Observation) -> tuple[DataFrame, list[str]]:
    """Count the groups with a changed row while the rows pass: a group's first row, changed ones first, tells."""
    first = F.row_number().over(Window.partitionBy(group_col).orderBy(F.col("_changed").desc()))
    rows = merged.withColumn("_first", first)
    out = rows.observe(seen, F.sum(F.when((F.col("_first") == 1) & F.col("_changed"), 1).otherwise(0)).alias("modified"))
    return out, [c for c in merged.columns if c != "_changed"]


_PART = "part_of_"


def write_parts(df: DataFrame, path: str, parts: int = 64, key: str = "product", mode: str = "errorifexists") -> None:
    """Store a keyed state in folders by a hash of ``key``, for merges that rewrite only the folders they touch.

    The folder's name tells the number of parts, so that no later merge can
    use another one. Size them so that one holds a few hundred MB.
    """
    part = f"{_PART}{parts}"
    out = df.withColumn(part, _part_of(key, parts))
    out.repartition(parts, part).write.mode(mode).partitionBy(part).parquet(path)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """The state stored by ``write_parts``, without its part column."""
    df = spark.read.parquet(path)
    return df.drop(*[c for c in df.columns if c.startswith(_PART)])


def _part_of(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def merge_parts(spark: SparkSession, path: str, updates: DataFrame, keys: Sequence[str] = ("product", "pincode"),
                value_cols: Sequence[str] = ("price", "quantity"), products: DataFrame | None = None,
                order_col: str | None = None, key: str = "product", unique: bool = False) -> tuple[int, int]:
    """Merge ``updates`` into a state stored by ``write_parts``, rewriting only the parts that hold an updated key.

    Returns (parts rewritten, documents modified). Only those parts are read
    (partition filter) and written (dynamic partition overwrite); bytes
    written follow the updates, not the state. State and updates are both
    dealt by part, so they meet and are written without a further exchange.
    The new files replace the old ones when the job commits: a failure before
    leaves the state as it was, and with ``order_col`` a repeated merge gives
    the same state. Updates should be stored or checkpointed, as they are read
    twice (once for the list of their parts, at most ``parts`` numbers).
    """
    state = spark.read.parquet(path)
    part = next(c for c in state.columns if c.startswith(_PART))
    parts = int(part.removeprefix(_PART))
    u = _prepare(updates, list(keys), list(value_cols), products, order_col, unique).withColumn(part, _part_of(key, parts))
    touched = sorted(r[part] for r in u.select(part).distinct().collect())
    if not touched:
        return 0, 0
    if order_col and order_col not in state.columns:
        raise ValueError(f"a state merged by {order_col!r} must hold that column")
    co_located_joins(spark)
    old = state.where(F.col(part).isin(touched)).repartition(len(touched), part)
    new = u.repartition(len(touched), part)
    merged = merge_values(old, new, [part, *keys], value_cols, None, order_col, True, None, "_changed")
    seen = Observation(f"merge {path}")
    out, cols = _observe_modified(merged, key, seen)
    out = out.select(*[c for c in cols if c != part], part)
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path))
    spark.catalog.refreshByPath(path)
    return len(touched), int(seen.get["modified"] or 0)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
                options: dict[str, str] | None = None, partition_by: Sequence[str] = ()) -> str:
    """Write ``df`` to ``path`` (the named target is honoured) and return it.

    The default mode refuses to overwrite, so a merge result goes to a new
    version folder and the previous version stays readable until replaced.
    """
    w = df.write.mode(mode).format(fmt).options(**(options or {}))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path
