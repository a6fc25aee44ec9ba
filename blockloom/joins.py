"""Joins whose hot keys stay where they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than its share of PARTS of the rows, and more than FEW, is hot: at most PARTS keys are.
PARTS, FEW = 1024, 64


def spread_join(rows: DataFrame, by: DataFrame, keys: list[str], total: int, n: str = "n") -> DataFrame:
    """rows joined to by, which has one row for each of their keys and in n how many of the total rows have it (n leaves).

    Rows of hot keys meet theirs by a broadcast of at most PARTS rows, in place; the others are shuffled, so no task gets
    more than its share of a key."""
    limit = max(FEW, total // PARTS)
    hot, calm = F.broadcast(by.where(F.col(n) > limit).drop(n)), by.where(F.col(n) <= limit).drop(n)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(calm, keys))
