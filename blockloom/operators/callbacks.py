"""Callbacks on the driver: hooks for stages of work, and an event log that becomes a relation."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EVENT

#: Stages that hooks may be told of.
HOOKS = ("parse_start", "parse_complete", "parse_error", "text_insert_start", "text_insert_complete", "multimodal_start", "multimodal_item_complete", "multimodal_complete", "query_start", "query_complete", "query_error", "document_complete", "document_error", "batch_start", "batch_complete")
log = logging.getLogger(__name__)


class Callbacks:
    """Tells each registered callback's on_<hook> of what happens; one that fails is logged and doesn't stop others."""

    def __init__(self, clock: Callable[[], float] = time.time):
        self.registered: list = []
        self.events: list[tuple] = []
        self.clock = clock

    def register(self, callback) -> None:
        if callback not in self.registered:
            self.registered.append(callback)

    def unregister(self, callback) -> None:
        if callback in self.registered:
            self.registered.remove(callback)

    def dispatch(self, hook: str, **what) -> None:
        if hook not in HOOKS:
            raise ValueError(f"no hook {hook}")
        known = ("file_path", "doc_id", "stage", "duration_seconds", "error")
        details = {k: str(v) for k, v in what.items() if k not in known}
        duration = what.get("duration_seconds")
        self.events.append((hook, self.clock(), what.get("file_path"), what.get("doc_id"), what.get("stage"), details, None if duration is None else float(duration), None if what.get("error") is None else str(what["error"])))
        for callback in list(self.registered):
            call = getattr(callback, f"on_{hook}", None)
            if call:
                try:
                    call(**what)
                except Exception:
                    log.exception("a callback failed on %s", hook)

    def table(self, spark: SparkSession) -> DataFrame:
        """The log as schema.EVENT."""
        from datetime import UTC, datetime

        return spark.createDataFrame([(e, datetime.fromtimestamp(t, UTC), *rest) for e, t, *rest in self.events], EVENT)

    def timed(self, hook: str, work: Callable, **what):
        """What work() gives; <hook>_start before it, then <hook>_complete or <hook>_error with its duration."""
        self.dispatch(f"{hook}_start", **what) if f"{hook}_start" in HOOKS else None
        began = self.clock()
        try:
            out = work()
        except Exception as e:
            if f"{hook}_error" in HOOKS:
                self.dispatch(f"{hook}_error", error=e, duration_seconds=self.clock() - began, **what)
            raise
        self.dispatch(f"{hook}_complete", duration_seconds=self.clock() - began, **what)
        return out


def document_events(states: DataFrame, at, key: str = "doc_id") -> DataFrame:
    """schema.EVENT rows of documents that are done or failed (status.document_states), without passing through the driver."""
    done = states.where("status in ('processed', 'failed')")
    return done.select(
        F.when(F.col("status") == "failed", "document_error").otherwise("document_complete").alias("event_type"), F.lit(at).cast("timestamp").alias("timestamp"), F.lit(None).cast("string").alias("file_path"), F.col(key).cast("string").alias("doc_id"),
        F.lit("ingest").alias("stage"), F.create_map(F.lit("chunks_count"), F.col("chunks_count").cast("string")).alias("details"), F.lit(None).cast("double").alias("duration_seconds"), "error",
    )
