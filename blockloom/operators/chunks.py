"""Chunks: paragraphs, pieces between separators, token windows, and templated descriptions of other blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hash_id, or_none, paragraphs, strip, tokens

#: What describes a block to readers of its chunk, by the block's type.
TEMPLATES = {
    "image": "\nImage Content Analysis:\nImage Path: {image_path}\nCaptions: {captions}\nFootnotes: {footnotes}\n\nVisual Analysis: {description}",
    "table": "Table Analysis:\nImage Path: {image_path}\nCaption: {captions}\nStructure: {table_body}\nFootnotes: {footnotes}\n\nAnalysis: {description}",
    "equation": "Mathematical Equation Analysis:\nEquation: {text}\nFormat: {text_format}\n\nMathematical Analysis: {description}",
    "generic": "{type} Content Analysis:\nContent: {extra}\n\nAnalysis: {description}",
}


def fill(template: str, **values: Column) -> Column:
    """A template's {names} replaced, each part a literal or a column, so that values are never read as templates."""
    import string

    parts = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name:
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*parts)


def title(x: Column) -> Column:
    """Every run of letters with a capital at its start, so that "custom_type" becomes "Custom_Type"."""
    words = F.transform(F.split(x, "_"), F.initcap)
    return F.array_join(words, "_")


def templated(kind: str, description: Column) -> Column:
    """The chunk of a block of that type, from the blocks' columns."""
    template = TEMPLATES.get(kind, TEMPLATES["generic"])
    return fill(
        template,
        image_path=F.col("img_path"),
        captions=or_none("captions"),
        footnotes=or_none("footnotes"),
        table_body=F.col("table_body"),
        text=F.col("text"),
        text_format=F.col("text_format"),
        type=title(F.col("type")),
        extra=F.coalesce(F.col("extra"), F.col("text")),
        description=description,
    )


def modal_chunk(description: Column) -> Column:
    out = F.when(F.col("type") == "image", templated("image", description))
    for kind in ("table", "equation"):
        out = out.when(F.col("type") == kind, templated(kind, description))
    return out.otherwise(templated("generic", description))


def paragraph_chunks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, chunk_order_index, content, tokens, chunk_id of a text's paragraphs."""
    df = docs.select(key, F.posexplode(paragraphs(text)).alias("chunk_order_index", "content"))
    return with_chunk_id(df.withColumn("tokens", tokens("content")), key)


def with_chunk_id(chunks: DataFrame, key: str) -> DataFrame:
    return chunks.withColumn("chunk_id", hash_id(F.concat_ws(":", F.col(key).cast("string"), F.col("chunk_order_index").cast("string"), F.col("content")), "chunk-"))


def split_chunks(docs: DataFrame, key: str, text: str, separator: str) -> DataFrame:
    """key, chunk_order_index, content of what stands between separators, stripped, blank parts left out."""
    parts = F.filter(F.transform(F.split(text, "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E"), strip), lambda p: p != "")
    return docs.select(key, F.posexplode(parts).alias("chunk_order_index", "content"))


def windows(text: Column, size: int, overlap: int) -> Column:
    """Overlapping windows over a text's words, as texts; none for a text without words."""
    step = size - overlap
    if step <= 0:
        raise ValueError("the overlap must be smaller than the window")
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def of(w: Column) -> Column:
        # the last window is the first that reaches the end
        last = F.ceil(F.greatest(F.size(w) - size, F.lit(0)) / step).cast("int")
        found = F.transform(F.sequence(F.lit(0), last), lambda k: F.array_join(F.slice(w, k * step + 1, size), " "))
        return F.when(F.size(w) > 0, found).otherwise(F.expr("cast(array() as array<string>)"))

    # a list of one: the words are split once, not for each window
    return F.element_at(F.transform(F.array(words), of), 1)


def window_chunks(docs: DataFrame, key: str, text: str, size: int = 1200, overlap: int = 100) -> DataFrame:
    """key, chunk_order_index, content, tokens of overlapping windows over a text's words."""
    df = docs.select(key, F.posexplode(windows(F.col(text), size, overlap)).alias("chunk_order_index", "content"))
    return df.withColumn("tokens", tokens("content"))


def progress(index: Column, n: Column) -> Column:
    """Whether to report after this many of n are done: ten times, or each time for fewer."""
    return index % F.greatest(F.lit(1), F.floor(n / 10)) == 0
