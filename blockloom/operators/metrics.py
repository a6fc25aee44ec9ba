"""Metrics over processing events, the same for tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Which events count as what, by event type.
ROLES = {"purchase": "document", "click": "query", "view": "parse", "signup": "insert", "error": "error"}
PRECISION = 4


def accumulate(events: DataFrame, *keys) -> DataFrame:
    """Counts and sums by role; events has event_type and value."""
    kind = {role: F.col("event_type") == name for name, role in ROLES.items()}
    total = lambda role: F.round(F.coalesce(F.sum(F.when(kind[role], F.col("value"))), F.lit(0.0)), PRECISION)
    return events.groupBy(*keys).agg(
        F.count_if(kind["document"]).alias("documents_processed"),
        F.count_if(kind["error"]).alias("documents_failed"),
        total("parse").alias("total_parse_time"),
        total("insert").alias("total_insert_time"),
        F.count_if(kind["query"]).alias("queries_executed"),
        total("query").alias("total_query_time"),
    )


def first_errors(events: DataFrame, key: str = "user_id", n: int = 5) -> DataFrame:
    """Each key's first n errors, by time then id, numbered from 1."""
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy(key).orderBy("ts", "event_id"))
    return events.where("event_type = 'error'").withColumn("nth", rank).where(F.col("nth") <= n)


def windows(events: DataFrame, size: str, slide: str | None = None, time: str = "ts") -> DataFrame:
    """event_type, window_start, n, total by tumbling or sliding windows."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return events.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), PRECISION).alias("total")).select("event_type", F.col("window.start").alias("window_start"), "n", "total")


def sessions(events: DataFrame, gap: str, key: str = "user_id", time: str = "ts") -> DataFrame:
    """key, session_start, n of runs of events no further apart than gap."""
    return events.groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("session_start"), "n")
