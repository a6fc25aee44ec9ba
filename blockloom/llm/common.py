"""Shared pieces of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..joins import FEW, PARTS, spread_join  # noqa: F401
from ..shared import discard, durable  # noqa: F401

#: Arrow batches handed to Python are held to this many bytes and rows, whatever the texts' lengths.
ARROW_BYTES, ARROW_ROWS = 8 << 20, 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session_of(df: DataFrame) -> SparkSession:
    """df's session, whose Arrow batches are held to ARROW_BYTES and ARROW_ROWS from now on, unless it has lower bounds.
    The bounds stay, as a lazy result reads them when it is computed."""
    spark = df.sparkSession
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        now = int(spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return spark


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_digest(doc_id: str, text: str) -> Column:
    """md5 hex that stands for a row: of its id and its text's md5, nulls as empty strings."""
    return F.md5(F.concat(F.coalesce(col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(col(text), F.lit("")))))


def packed(df: DataFrame, name: str = "row") -> Column:
    """All columns of df as one struct, so that an operator's own columns clash with none of them; name.* unpacks it."""
    return F.struct(*map(col, df.columns)).alias(name)
