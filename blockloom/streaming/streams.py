"""Streams: metrics by event-time windows, breaker states, re-delivered chunks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import metrics
from ..operators.status import latest
from ..shared import shared_folder, with_rocksdb

THRESHOLD, RESET_SECONDS = 3, 3600.0
STATES = "user_id long, n_failures int, state string, n_rejected long, last_failure double"


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """Events of a folder's files as a stream; times are read as UTC instants."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(stream: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    return metrics.windows(stream.withWatermark("ts", late), size, slide)


def once_each(stream: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Without rows that were delivered before, within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def drained(df: DataFrame, mode: str = "complete", keys: tuple[str, ...] = ()) -> DataFrame:
    """What a stream gives once all that is there now has been read: the last table of a complete stream, all rows of an
    appending one, the latest row of each key of an updating one.

    State and batches go to the shared folder, each batch to a path of its own, so that one that is tried again
    replaces itself; nothing passes through the driver."""
    spark, folder, batches = df.sparkSession, f"{shared_folder(df.sparkSession)}/stream-{uuid.uuid4()}", []

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/rows/{n:09d}")
        batches.append(n)

    with with_rocksdb(spark):
        query = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not batches:
        return spark.createDataFrame([], df.schema)
    rows = spark.read.parquet(*(f"{folder}/rows/{n:09d}" for n in ([max(batches)] if mode == "complete" else sorted(set(batches)))))
    return (latest(rows, list(keys), "_batch") if mode == "update" else rows).drop("_batch")


class Breaker:
    """closed -> open after `threshold` failures, none `reset` seconds after the one before; open -> half-open `reset`
    seconds after the last; half-open -> closed on success, open on failure. While open, calls are rejected."""

    def __init__(self, threshold: int = THRESHOLD, reset: float = RESET_SECONDS, failures: int = 0, state: str = "closed", last: float | None = None, rejected: int = 0):
        self.threshold, self.reset, self.failures, self.state, self.last, self.rejected = threshold, reset, failures, state, last, rejected

    def call(self, at: float, ok: bool) -> None:
        if self.state == "open" and at - self.last >= self.reset:
            self.state = "half-open"
        if self.state == "open":
            self.rejected += 1
        elif ok:
            self.failures, self.state = 0, "closed"
        else:
            stale = self.last is not None and at - self.last >= self.reset
            self.failures = self.threshold if self.state == "half-open" else 1 if stale else self.failures + 1
            self.last = at
            self.state = "open" if self.failures >= self.threshold else "closed"


class BreakerProcessor(StatefulProcessor):
    """One breaker for each key; a key's events are taken in order of time within a batch.

    A batch's events of a key are held while they are sorted, as two numbers and a flag each: no more than the trigger lets in (maxFilesPerTrigger and the like)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("breaker", "failures int, state string, last double, rejected long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = self.held.get()
        b = Breaker() if got is None else Breaker(failures=got[0], state=got[1], last=got[2], rejected=got[3])
        held = [(part["at"].to_numpy(), part["event_id"].to_numpy(), (part["event_type"] != "error").to_numpy()) for part in rows]
        at, ids, ok = (np.concatenate(x) for x in zip(*held, strict=True))
        for k in np.lexsort((ids, at)):
            b.call(float(at[k]), bool(ok[k]))
        self.held.update((b.failures, b.state, b.last, b.rejected))
        yield pd.DataFrame({"user_id": [key[0]], "n_failures": [b.failures], "state": [b.state], "n_rejected": [b.rejected], "last_failure": [b.last]})

    def close(self) -> None:
        pass


def breaker_stream(stream: DataFrame) -> DataFrame:
    """The breaker's state of each user after each batch; needs the RocksDB state store (drained() sees to it)."""
    rows = stream.select("user_id", "event_id", "event_type", F.unix_micros("ts").cast("double").alias("us")).withColumn("at", F.col("us") / 1e6).drop("us")
    return rows.groupBy("user_id").transformWithStateInPandas(BreakerProcessor(), STATES, "Update", "None")


#: Events of a chunk, as aimed at.
CHUNK_ROWS = 1 << 16
_EXITS = "user_id long, part int, kind int, at long, first_at long, first_ok boolean, n long, failures int, state string, last long, rejected long"
Exit = tuple[int, str, int | None, int]  # failures, state, time of the failure that opened it, calls rejected until then


def chunk_exits(at: list[int], ok: list[bool], threshold: int, reset: int) -> list[tuple[int, int, Exit]]:
    """What a chunk of one user's events in order makes of every state that it may be entered in: (kind, time, exit).

    Kinds 0 to threshold - 1: closed after so many failures (of which the last is taken to be recent). Kind threshold: open,
    with the first event that is let through at this time; states that let through the same event are one row, and so are
    those that end alike. An exit closed without failures doesn't depend on older ones, so it holds no time. Found
    backwards, from each event by what follows it."""
    n = len(at)
    through = np.searchsorted(np.array(at), np.array(at) + reset).tolist()  # by an open breaker whose last failure is this event
    opened: list[Exit] = [(0, "", None, 0)] * n
    after: list[list[Exit]] = [[] for _ in range(n + 1)]  # closed with so many failures before event i
    after[n] = [(f, "closed", at[n - 1] if f else None, 0) for f in range(threshold)]
    for i in range(n - 1, -1, -1):
        j = through[i]
        if j >= n:
            opened[i] = (threshold, "open", at[i], n - 1 - i)
        else:
            f, state, last, rejected = after[j + 1][0] if ok[j] else opened[j]
            opened[i] = (f, state, last, rejected + j - i - 1)
        if ok[i]:
            after[i] = [after[i + 1][0]] * threshold
        else:
            stale = i > 0 and at[i] - at[i - 1] >= reset
            more = [1 if stale or not f else f + 1 for f in range(threshold)]
            after[i] = [opened[i] if f >= threshold else after[i + 1][f] for f in more]
    out = [(f, 0, x) for f, x in enumerate(after[0])]
    rows: list[tuple[int, int, Exit]] = []
    for j in range(n):
        if not j or at[j] != at[j - 1]:
            f, state, last, rejected = after[j + 1][0] if ok[j] else opened[j]
            row = (threshold, at[j], (f, state, last, rejected + j))
            if rows and rows[-1][2] == row[2]:
                rows.pop()
            rows.append(row)
        if at[j] >= at[0] + reset:
            break
    return out + rows


def breaker_table(events: DataFrame, threshold: int = THRESHOLD, reset: float = RESET_SECONDS) -> DataFrame:
    """The same of a table; events without a time are left out. A user's events, however many, are dealt by time to chunks of bounded size; each task turns its
    chunks into tables from entry to exit state, which one task a user reads in order: a few rows a chunk, and one for
    each event of a chunk's first reset seconds at most, as an open breaker may let any of these through."""
    rows = events.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", (F.col("event_type") != "error").alias("ok")).where("at is not null")
    parts = max(1, -(-rows.count() // CHUNK_ROWS))
    rows = rows.repartitionByRange(parts, "user_id", "at", "event_id").sortWithinPartitions("user_id", "at", "event_id")
    span = int(reset * 1e6)

    def summed(batches):
        def table(user, part, held):
            at, ok = (np.concatenate(x).tolist() for x in zip(*held, strict=True))
            found = chunk_exits(at, [bool(x) for x in ok], threshold, span)
            cols = zip(*((user, part, kind, t, at[0], bool(ok[0]), len(at), *x) for kind, t, x in found), strict=True)
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in _EXITS.split(", ")])

        user, part, held = None, None, []
        for batch in batches:
            users = batch.column("user_id").to_pylist()
            at, ok = batch.column("at").to_numpy(), batch.column("ok").fill_null(True).to_numpy(zero_copy_only=False)
            cuts = [0, *(k for k in range(1, len(users)) if users[k] != users[k - 1]), len(users)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and users[a] != user:
                    yield table(user, part, held)
                    held = []
                if b > a:
                    user, part = users[a], batch.column("part")[a].as_py()
                    held.append((at[a:b], ok[a:b]))
        if held:
            yield table(user, part, held)

    tables = rows.withColumn("part", F.spark_partition_id()).select("user_id", "part", "at", "ok").mapInArrow(summed, _EXITS)
    tables = tables.repartition("user_id").sortWithinPartitions("user_id", "part", "kind", "at")

    def composed(batches):
        def taken(now: Exit, chunk: list[dict]) -> Exit:
            f, state, last, rejected = now
            first = chunk[0]
            if state == "closed":
                old = f and last is not None and not first["first_ok"] and first["first_at"] - last >= span
                row = chunk[0 if old else f]
            else:
                row = next((r for r in chunk[threshold:] if r["at"] >= last + span), None)
                if row is None:
                    return f, state, last, rejected + first["n"]
            return row["failures"], row["state"], row["last"], rejected + row["rejected"]

        start: Exit = (0, "closed", None, 0)
        users, states, key, now, chunk = [], [], None, start, []
        for batch in batches:
            for r in batch.to_pylist():
                if chunk and (r["user_id"], r["part"]) != key:
                    now = taken(now, chunk)
                    chunk = []
                    if r["user_id"] != key[0]:
                        users.append(key[0])
                        states.append(now)
                        now = start
                key = r["user_id"], r["part"]
                chunk.append(r)
        if chunk:
            users.append(key[0])
            states.append(taken(now, chunk))
        yield pa.RecordBatch.from_arrays([pa.array(users, pa.int64()), *(pa.array([s[k] for s in states], t) for k, t in ((0, pa.int32()), (1, pa.string()), (3, pa.int64())))], names=["user_id", "n_failures", "state", "n_rejected"])

    return tables.mapInArrow(composed, "user_id long, n_failures int, state string, n_rejected long")
