"""Where intermediate tables go, the size check in front of every broadcast, parallel jobs."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

BROADCAST_LIMIT_BYTES = 64 << 20
ROW_OVERHEAD_BYTES = 32

#: For tables of few rows with megabytes each: writers look at the size after every row, so that neither they nor
#: readers, which hold a row group at most, have more than some of these rows in memory.
PACKED = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "4"}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, taken from ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="topicdrift-"))
    return context.getCheckpointDir()


# Paths of intermediate tables, one list per open scope of a thread; see `side_by_side` for the
# threads that work for a scope.
_open = threading.local()


def _scopes() -> list[list[str]]:
    if not hasattr(_open, "scopes"):
        _open.scopes = []
    return _open.scopes


@contextmanager
def intermediate_tables(spark: SparkSession) -> Iterator[None]:
    """Owns the intermediate tables made inside: they are deleted when the scope ends.

    A result that reads them lazily must be written or collected inside the scope. Without
    a scope the tables stay until the folder of ``spark.checkpoint.dir`` is cleaned.
    Shuffle files that only jobs inside needed go, too.
    """
    own: list[str] = []
    scopes = _scopes()
    scopes.append(own)
    try:
        yield
    finally:
        # Lists of paths can be equal: this one, not the first that is like it.
        scopes[:] = [one for one in scopes if one is not own]
        for name in own:
            delete_table(spark, name)
        release_shuffles(spark)


def delete_table(spark: SparkSession, name: str) -> None:
    """Delete a table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(spark: SparkSession, name: str) -> None:
    """`delete_table`, if an open scope owns the table; others stay until their folder is cleaned."""
    if any(name in own for own in _scopes()):
        delete_table(spark, name)


def release_shuffles(spark: SparkSession) -> None:
    """Executors delete the shuffle files of a job when the driver has collected its traces, which a driver with
    memory to spare puts off; long runs of jobs fill the disks meanwhile."""
    gc.collect()
    spark._jvm.System.gc()


def new_table_path(spark: SparkSession) -> str:
    """A new path in the shared folder; the innermost open scope owns it."""
    path = f"{shared_folder(spark).rstrip('/')}/topicdrift-{uuid.uuid4().hex}"
    if _scopes():
        _scopes()[-1].append(path)
    return path


def stored(
    df: DataFrame, schema: T.StructType | None = None, partition_by: Sequence[str] = (), options: Mapping[str, str] = {},
    path: str | None = None,
) -> DataFrame:
    """Write ``df`` to a new table in the shared folder (or to a path from `new_table_path`) and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = path or new_table_path(spark)
    df.write.options(**options).partitionBy(*partition_by).parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def size_in_bytes(df: DataFrame) -> int:
    """Measured in-memory size of a flat frame: string bytes plus a fixed amount per row."""
    width = F.lit(ROW_OVERHEAD_BYTES + 8 * len(df.columns)).cast("bigint")
    for field in df.schema:
        if isinstance(field.dataType, T.StringType):
            width = width + F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0))
    return df.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it measures at most ``limit`` bytes, else as it is.

    Without the hint the join shuffles, and adaptive execution splits skewed keys.
    """
    return F.broadcast(df) if size_in_bytes(df) <= limit else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` hash-partitioned by its keys if the scan has fewer splits than there are cores.

    For small or unsplittable input only; a large scan has splits enough and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def side_by_side(spark: SparkSession, work: Callable, items: Sequence, parallelism: int) -> list:
    """Results of ``work`` per item, in order; up to ``parallelism`` submit jobs at a time.

    Intermediate tables of all items belong to the scope open here.
    """
    if parallelism == 1 or len(items) < 2:
        return [work(item) for item in items]
    scopes = _scopes()

    def scoped(item):
        _open.scopes = list(scopes)
        return work(item)

    with ThreadPool(min(parallelism, len(items))) as pool:
        return pool.map(inheritable_thread_target(spark)(scoped), items, chunksize=1)
