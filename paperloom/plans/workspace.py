"""Intermediate tables in the folder that all machines of a cluster share.

A stage that several later jobs read is written once as Parquet under ``spark.checkpoint.dir``. That
cuts its lineage and survives the loss of executors, and unlike a checkpoint it is columnar, so later
jobs read only the columns they need.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_live: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where none is set and Spark runs on one machine, a temporary folder."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    root = root or context.getCheckpointDir()
    if not root and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        context.setCheckpointDir(root)
        root = context.getCheckpointDir()
    return root.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder. It is deleted when the driver ends."""
    path = f"{shared_root(spark)}/paperloom/{uuid.uuid4().hex}-{label}"
    _live.append((spark, path))
    return path


def save(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table that reads it back."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._paperloom_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`save` that nothing reads any more."""
    for table in tables:
        if path := getattr(table, "_paperloom_path", None):
            _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _live[:] = [x for x in _live if x[1] != path]


@atexit.register
def _sweep() -> None:
    for spark, path in list(_live):
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone by now
            return


#: Rows of a batch that goes to a Python worker; whole texts may be long.
ARROW_ROWS = 500


def ship(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver has it."""
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if home not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([home, *filter(None, paths)])
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= ARROW_ROWS:
        spark.conf.set(rows, ARROW_ROWS)


def parts_of(spark: SparkSession) -> int:
    """Parts for work whose cost is in Python: few bytes are not little work."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(table: DataFrame) -> DataFrame:
    """Deal a stored table's rows out before such work, if it is read in fewer parts than there are cores; else leave it."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(parts_of(table.sparkSession))


def give_back() -> None:
    """Return a worker's freed memory to the machine: workers live on, and what one task needed is not there for the next."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: Bytes that one broadcast may take, by the sizes that Spark gives a row's types and what a hash table adds to each row.
BROADCAST_BYTES, ROW_BYTES = 96 << 20, 24


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only after counting: beyond ``max_rows`` rows, or so many as fit ``BROADCAST_BYTES``, the join shuffles instead."""
    from pyspark.sql import functions as F

    fitting = min(max_rows, BROADCAST_BYTES // (df._jdf.schema().defaultSize() + ROW_BYTES))
    return F.broadcast(df) if df.limit(fitting + 1).count() <= fitting else df
