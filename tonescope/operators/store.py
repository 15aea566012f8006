"""Tables that later steps read again: written once to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import uuid
import weakref

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_tables: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder in spark.checkpoint.dir; one of our own only where it is unset and all runs on this machine."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if folder is not None:
        return folder.rstrip("/")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, name: str = "table") -> str:
    """A path in the shared folder that nobody uses; it is removed when the session's program ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stored(df: DataFrame, **options: object) -> DataFrame:
    """df computed once, as a table in the shared folder, which survives lost executors. options: those of its writer."""
    path = new_path(df.sparkSession)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _tables[out] = path
    return out


def dropped(table: DataFrame) -> None:
    """Delete a table of stored() that no later step reads; shuffle files go with the plans that made them."""
    spark = table.sparkSession
    _delete(spark, _tables.pop(table))
    give_back()
    spark._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may be over; the folder belongs to the cluster's own cleaning then
            return


#: Rows and bytes of an Arrow batch at most (a longer row is a batch by itself), as texts can be long.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to that, unless it has less."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int("".join(filter(str.isdigit, spark.conf.get(key))) or 0)
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(task):
    """An Arrow task that gives freed memory back to the system when it ends; its worker lives on for other tasks."""

    @functools.wraps(task)
    def run(batches):
        try:
            yield from task(batches)
        finally:
            give_back()

    return run
