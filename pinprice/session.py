"""Session defaults and the shared working folder.

Operators never build a session; entry points and tests call
``build_session`` and hand the session down.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Defaults that matter at scale: adaptive execution (coalesce small shuffle
# partitions, split skewed join partitions, switch to broadcast when a side
# turns out small at runtime) and UTC timestamps for oracle comparisons.
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # a state bucketed by product meets updates dealt by product on (product,
    # pincode) without an exchange of either
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # rows that come in the order of a grouping are aggregated as they pass,
    # where a hash aggregate of lists would sort them again
    "spark.sql.execution.replaceHashWithSortAgg": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app_name: str = "pinprice",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with the library defaults.

    ``master`` is left to the cluster launcher when None.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def co_located_joins(spark: SparkSession) -> None:
    """Let tables dealt by some of a join's keys be joined as they lie, also in a session built elsewhere."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    spark.conf.set(key, SESSION_DEFAULTS[key])


def streamed_groups(spark: SparkSession) -> None:
    """Let rows that come in the order of a grouping be aggregated as they pass, also in a session built elsewhere."""
    key = "spark.sql.execution.replaceHashWithSortAgg"
    spark.conf.set(key, SESSION_DEFAULTS[key])


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within, shuffle files go when their query ends, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextmanager
def batch_bytes(spark: SparkSession, limit: int) -> Iterator[None]:
    """Within, rows go to Python in batches of about ``limit`` bytes at most."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(limit))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _checkpoint_dir(spark: SparkSession) -> str | None:
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    try:
        return spark.conf.get("spark.checkpoint.dir", None) or None
    except Exception:  # noqa: BLE001 - conf lookup of an unset key
        return None


def shared_dir(spark: SparkSession, *parts: str, unique: bool = True) -> str:
    """A folder every executor can reach, under ``spark.checkpoint.dir``.

    On a cluster the setting must name shared storage; it is only filled in
    here (with a local temporary folder) when the session runs in local
    mode and nothing is configured, as in tests.
    """
    base = _checkpoint_dir(spark)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at shared storage")
        base = tempfile.mkdtemp(prefix="pinprice-ckpt-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir() or base
    path = base.rstrip("/")
    for p in parts:
        path = f"{path}/{p}"
    if unique:
        path = f"{path}/{uuid.uuid4().hex}"
    return path


def materialised(df: DataFrame, *names: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, and no shuffle file stays.

    Columns are compressed, where ``checkpoint`` keeps rows as they are in memory.
    """
    spark = df.sparkSession
    path = shared_dir(spark, *names)
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a table that ``materialised`` wrote and that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


__all__ = ["SESSION_DEFAULTS", "batch_bytes", "build_session", "co_located_joins", "dropped", "materialised", "shared_dir", "shuffles_freed",
           "streamed_groups"]
