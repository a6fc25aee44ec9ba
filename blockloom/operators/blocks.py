"""Operators within a document, on its array of blocks: no shuffle, no explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, hash_id, strip

SEPARATOR = "\n\n"


def text_of(blocks: Column | str) -> Column:
    """Non-blank text blocks in order, apart by a blank line."""
    texts = F.filter(blocks, lambda b: (F.coalesce(b["type"], F.lit("text")) == "text") & ~blank(b["text"]))
    return F.array_join(F.transform(texts, lambda b: b["text"]), SEPARATOR)


def items_of(blocks: Column | str) -> Column:
    """All other blocks, in order."""
    return F.filter(blocks, lambda b: F.coalesce(b["type"], F.lit("text")) != "text")


def separate(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"text_content": text_of("blocks"), "items": items_of("blocks")})


def signature(b: Column) -> Column:
    """A block's share in its document's id: its own content, or for blocks of other types or without any all that it
    holds, as JSON with its fields in the order of the schema, nulls left out, its position not counted."""
    some = lambda x: F.coalesce(x, F.lit("")) != ""
    return (
        F.when((b["type"] == "text") & some(b["text"]), strip(b["text"]))
        .when((b["type"] == "image") & some(b["img_path"]), F.concat(F.lit("image:"), b["img_path"]))
        .when((b["type"] == "table") & some(b["table_body"]), F.concat(F.lit("table:"), b["table_body"]))
        .when((b["type"] == "equation") & some(b["text"]), F.concat(F.lit("equation:"), b["text"]))
        .otherwise(F.to_json(b.dropFields("pos")))
    )


def content_id(blocks: Column | str) -> Column:
    return hash_id(F.array_join(F.transform(blocks, signature), "\n"), "doc-")


def type_counts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, type, n. Counts come from within each document, so nothing is shuffled."""
    types = F.transform("blocks", lambda b: F.coalesce(b["type"], F.lit("unknown")))
    counted = F.transform(F.array_distinct(types), lambda t: F.struct(t.alias("type"), F.size(F.filter(types, lambda x: x == t)).cast("long").alias("n")))
    return docs.select(key, F.inline(counted))


def recovered(docs: DataFrame) -> DataFrame:
    """Text blocks, else any block's text."""
    texts = F.filter("blocks", lambda b: ~blank(b["text"]))
    return docs.withColumn("text_content", F.coalesce(F.nullif(text_of("blocks"), F.lit("")), F.array_join(F.transform(texts, lambda b: strip(b["text"])), SEPARATOR)))
