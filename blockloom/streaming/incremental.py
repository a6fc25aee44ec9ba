"""Incremental ingest: what changed among files, by state, and tables that take only that.

A stream says which files are there (path, mtime, and what else it knows of them), time and again. The state of each path
is the time last seen: a file comes through when it is new or has another time than that, so of files that didn't
change nothing is read and no table is searched. Each batch's changes replace their rows in a keyed table, of which only
the buckets that these paths fall into are touched."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.tables import KeyedTable
from ..shared import with_rocksdb

CHANGES = "path string, mtime long, before long"


class Changed(StatefulProcessor):
    """The last time of each path. A batch may name a path often; its greatest time counts, older ones than the state's don't."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "mtime long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = max(int(part["mtime"].max()) for part in rows)
        got = self.seen.get()
        if got is None or now > got[0]:
            self.seen.update((now,))
            yield pd.DataFrame({"path": [key[0]], "mtime": [now], "before": pd.array([None if got is None else got[0]], dtype="Int64")})

    def close(self) -> None:
        pass


def changes(listing: DataFrame) -> DataFrame:
    """path, mtime, before (null if new) of the files of a stream (path, mtime) that are new or changed; needs the RocksDB state store."""
    return listing.where("path is not null and mtime is not null").select("path", "mtime").groupBy("path").transformWithStateInPandas(Changed(), CHANGES, "Update", "None")


def ingest_changes(listing: DataFrame, read: Callable[[DataFrame], DataFrame], table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Keeps table (keyed by path, any number of rows each) up with a stream of listings. read: the rows of changed files
    (path, mtime), from wherever their content is; it is asked for these only. Files of which it gives no rows lose theirs.

    A batch that is tried again replaces the same paths by the same rows, so each counts once."""

    def write(batch: DataFrame, _: int) -> None:
        new = batch.select("path", "mtime")
        rows = read(new)
        table.upsert(rows, many=True)
        gone = new.join(rows.select("path").distinct(), "path", "left_anti")
        if not gone.isEmpty():
            table.delete(gone)

    with with_rocksdb(listing.sparkSession):
        return changes(listing).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_new(spark: SparkSession, folder: str, table: str, schema, checkpoint: str, keys: list[str], transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """JSON files that come to a folder, transformed and merged into a keyed table: of rows of one key the last batch's stay."""
    into = KeyedTable(spark, table, keys)

    def write(batch: DataFrame, _: int) -> None:
        into.upsert(transform(batch).dropDuplicates(keys))

    stream = spark.readStream.schema(schema).json(folder)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def listed(files: DataFrame) -> DataFrame:
    """A listing's rows (sources.files.listing) as this stream wants them; times in microseconds."""
    return files.select("path", F.unix_micros("modificationTime").alias("mtime"))
