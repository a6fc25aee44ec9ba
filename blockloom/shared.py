"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only a local master without that setting gets a temporary folder."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="blockloom-checkpoints-"))
    return context.getCheckpointDir()


#: Shuffle files of a query go when it ends, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame) -> DataFrame:
    """Materialises df in the shared checkpoint folder, cutting its lineage; the shuffle files that it took are removed."""
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a query of its own, planned under this setting
    finally:
        spark.conf.set(CLEANUP, before)


def discard(*done: DataFrame) -> None:
    """Deletes what durable() wrote for these, which nothing may read any more."""
    for df in done:
        path = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if path.isDefined():
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path.get())
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that are started within keep their state in RocksDB, as operators with state of their own need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
