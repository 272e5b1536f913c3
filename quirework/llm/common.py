"""Session and storage helpers shared by the training-data operators.

Intermediate tables are Parquet files below the folder named by
``spark.checkpoint.dir`` - the only folder that executors and driver share on a
cluster - so that a lost executor costs a re-read, never a recomputation of the
whole lineage.
"""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions.shipping import shared_folder, ship
from quirework.llm import hashing

#: A side is broadcast only when its measured row count times row width stays below this.
BROADCAST_BYTES = 32 << 20

#: A writer holds a row group in memory until it is full; 128 MB a task is Parquet's own bound.
ROW_GROUP_BYTES = 16 << 20
#: Bytes of an Arrow batch on its way to a Python worker; a single larger row still goes alone.
BATCH_BYTES = 2 << 20
#: Rows that the Parquet reader decodes at once; 4096 long texts would be vectors of tens of megabytes.
READ_ROWS = 512
_MEMORY_CONF = {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES), "spark.sql.parquet.columnarReaderBatchSize": str(READ_ROWS)}


def shared_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``; an own one in a local session without it, an error on a cluster."""
    sc, root = spark.sparkContext, shared_folder(spark)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(root)
    return root


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Intermediate tables of one operator call.

    ``save`` writes a table and reads it back; ``drop`` deletes the tables that the
    returned result no longer reads. What a lazy result still reads stays until the
    session ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        bound_memory(spark)
        self.spark, self.root = spark, f"{shared_root(spark)}/quirework-{name}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[str, str] = {}
        _live.setdefault(spark.sparkContext.applicationId, []).append(self)

    def save(self, df: DataFrame, table: str) -> DataFrame:
        path = f"{self.root}/{table}"
        df.write.mode("overwrite").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
        self.paths[table] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: str) -> None:
        for table in tables or tuple(self.paths):
            if path := self.paths.pop(table, None):
                _delete(self.spark, path)


_live: dict[str, list[Scratch]] = {}


@atexit.register
def _sweep() -> None:
    session = SparkSession.getActiveSession()
    if session is None or session.sparkContext._jsc is None:
        return
    for scratch in _live.get(session.sparkContext.applicationId, []):
        try:
            _delete(session, scratch.root)
        except Exception:  # the JVM may be gone already; the folder is scratch
            return


def _give_back() -> None:
    """Returns what a task's arrays and batches held: workers are reused and would keep it."""
    hashing.forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        return


def _lean(run: Callable) -> Callable:
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return held


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` over batches of at most BATCH_BYTES, in workers that give memory back after a task.

    Spark's own bound is 10 000 rows or 64 MB: with long texts a batch, its copy as Python
    objects and the JVM's buffers would take the executor's memory several times over.
    """
    spark = df.sparkSession
    bound_memory(spark)
    return df.mapInArrow(_lean(run), schema)


def bound_memory(spark: SparkSession) -> None:
    """Sends the sources once, and bounds what the session's readers and batches hold."""
    ship(spark)
    for key, value in _MEMORY_CONF.items():
        spark.conf.set(key, value)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_memory(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_memory(spark)
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def fits_broadcast(df: DataFrame, row_bytes: int) -> bool:
    """Whether the table, at ``row_bytes`` of values a row, is small enough to broadcast; counts it.

    A row in a hash table takes about four times the bytes of its values.
    """
    return 4 * df.count() * row_bytes <= BROADCAST_BYTES


def maybe_broadcast(df: DataFrame, row_bytes: int) -> DataFrame:
    """Broadcast hint if the measured size allows it; a shuffle join otherwise."""
    return F.broadcast(df) if fits_broadcast(df, row_bytes) else df.hint("merge")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
