"""Session helpers: tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
import weakref
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``.  Only a local
    session without that setting gets a temporary folder of its own.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="reviewlens-checkpoint-")
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir()


def tables_folder(spark: SparkSession) -> str:
    """The folder of this application's tables."""
    return f"{ensure_checkpoint_dir(spark)}/tables/{spark.sparkContext.applicationId}"


def drop_tables(spark: SparkSession) -> None:
    """Delete this application's tables; call it when results that still read them have been written."""
    _delete(spark, tables_folder(spark))


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, which cuts its lineage.

    A written table survives lost executors like a checkpoint does.  Unlike one it
    carries no optimizer constraints of the old plan, which double with every pass of
    a loop, and it is read with its true size and with column pruning.
    """
    path = f"{tables_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    with _shuffles_deleted(df.sparkSession):
        df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[table] = path
    return table


#: With this setting Spark deletes the shuffle files of an action when it has ended.
_DELETED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing, _writers = threading.Lock(), {}


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """A finished write leaves no shuffle files: nothing else reads them, and many rounds of writes would fill the disk."""
    with _writing:
        count, before = _writers.get(spark, (0, None))
        if not count:
            before = spark.conf.get(_DELETED)
            spark.conf.set(_DELETED, "true")
        _writers[spark] = count + 1, before
    try:
        yield
    finally:
        with _writing:
            count, before = _writers.pop(spark)
            if count > 1:
                _writers[spark] = count - 1, before
            else:
                spark.conf.set(_DELETED, before)


#: Folders of the tables that are still referred to.
_written: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def release(*tables: DataFrame) -> None:
    """Delete what ``materialise`` wrote for ``tables``; call it when all that reads them has itself been written."""
    for table in tables:
        path = _written.pop(table, None)
        if path:
            _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


#: Chains of Spark jobs that run at a time.  One chain of short jobs leaves most cores idle.
CHAINS = 8


def together(jobs: list[Callable]) -> list:
    """Results of functions without arguments, ``CHAINS`` of them running at a time, in the order given.

    The functions submit Spark jobs; a function that is itself run this way may call it again.
    """
    with ThreadPoolExecutor(CHAINS) as pool:
        return list(pool.map(lambda job: job(), jobs))
