"""Context of a block: texts on nearby pages or at nearby positions.

Pages and positions are ordered within a document, so one sort by document serves every window; a frame holds only the
window's blocks, never a document's pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import blank, strip, truncate

DEFAULT = Config()
LONG = 5000


def item_text(config: Config = DEFAULT, of: Column | None = None) -> Column:
    """What a block adds to others' context: of a row's columns, or of a struct."""
    get = F.col if of is None else of.getField
    text, kind = F.coalesce(get("text"), F.lit("")), get("type")
    if config.include_headers:
        level = F.coalesce(get("text_level"), F.lit(0))
        text = F.when(level > 0, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text)).otherwise(text)
    out = F.when(kind == "text", text)
    if config.include_captions:
        said = F.array_join(get("captions"), ", ")
        for name in ("image", "table"):
            some = (kind == name) & (F.coalesce(F.size(get("captions")), F.lit(0)) > 0)
            out = out.when(some, F.concat(F.lit(f"[{name.title()}: "), said, F.lit("]")))
    return out.otherwise("")


def _said(config: Config, b: Column) -> Column:
    """A block's struct as (p: position, g: page, s: what it says), null if it says nothing."""
    s = item_text(config, b)
    return F.when(b["type"].isin(*config.context_filter_types) & ~blank(s), F.struct(b["pos"].alias("p"), F.coalesce(b["page_idx"], F.lit(0)).alias("g"), s.alias("s")))


def _joined(near: Column, page: Column | None, config: Config) -> Column:
    """Texts in order of position, those of other pages marked."""
    text = lambda x: x["s"] if page is None else F.when(x["g"] == page, x["s"]).otherwise(F.concat(F.lit("[Page "), x["g"].cast("string"), F.lit("] "), x["s"]))
    return truncate(F.array_join(F.transform(F.array_sort(near), text), "\n"), config.max_context_tokens)


def document_context(docs: DataFrame, config: Config = DEFAULT, key: str = "doc_id") -> DataFrame:
    """page_context or chunk_context (by config.context_mode) of documents as arrays of blocks: key, the blocks that
    aren't text, their context. Nothing is shuffled, at two to three times a window's processor time: for clusters whose
    network is the narrow part. Documents of over LONG blocks go through the windows, as the work within a row grows
    with its pages times its blocks."""
    w, by_page = config.context_window, config.context_mode == "page"
    short = docs.where(F.size("blocks") <= LONG).select(key, "blocks")
    said = F.filter(F.transform("blocks", lambda b: _said(config, b)), lambda x: x.isNotNull())
    if by_page:
        pages = F.array_distinct(F.transform("_said", lambda x: x["g"]))
        short = short.withColumn("_said", said).withColumn("_by", F.map_from_arrays(pages, F.transform(pages, lambda g: F.filter("_said", lambda x: x["g"] == g))))
        short = short.select(key, "_by", F.inline(F.filter("blocks", lambda b: b["type"] != "text")))
        page = F.coalesce("page_idx", F.lit(0))
        near = F.flatten(F.transform(F.sequence(page - w, page + w), lambda g: F.coalesce(F.try_element_at("_by", g), F.expr("cast(array() as array<struct<p:int,g:int,s:string>>)"))))
        short = short.withColumn("context", _joined(near, page, config)).drop("_by")
    else:
        # a block's neighbours, by place in the array
        place = F.transform("blocks", lambda b, i: F.struct(b.alias("b"), F.slice(F.col("blocks"), F.greatest(i - w + 1, F.lit(1)), i + w + 1 - F.greatest(i - w, F.lit(0))).alias("near")))
        short = short.select(key, F.explode(F.filter(place, lambda x: x["b"]["type"] != "text")).alias("_x"))
        near = F.filter(F.transform("_x.near", lambda b: F.when(b["pos"] != F.col("_x.b.pos"), _said(config, b))), lambda x: x.isNotNull())
        short = short.withColumn("context", _joined(near, None, config)).select(key, "_x.b.*", "context")
    long = docs.where(F.size("blocks") > LONG).select(key, F.inline("blocks"))
    return short.unionByName((page_context if by_page else chunk_context)(long, config, key))


def _usable(config: Config) -> Column:
    return F.col("type").isin(*config.context_filter_types) & ~blank("_said")


def page_context(blocks: DataFrame, config: Config = DEFAULT, key: str = "doc_id", of: Column | None = None) -> DataFrame:
    """blocks with context: texts of pages at most context_window away, those of other pages marked. of: which blocks are wanted, those that aren't text by default.

    A running sum of a page's lengths, a line end behind each text, finds the texts that lie beyond the limit whatever stands
    before the page, and leaves them out before texts are gathered; the first one past the limit stays, so that the cut is seen; so a row holds the limit's worth of each page in its window, even where a
    document is one page of very many blocks. One shuffle and one sort by document, page and position serve both windows."""
    page = F.coalesce(F.col("page_idx"), F.lit(0))
    within = W.partitionBy(key, "_page").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    frame = W.partitionBy(key).orderBy("_page").rangeBetween(-config.context_window, config.context_window)
    df = blocks.withColumn("_page", page).withColumn("_said", item_text(config)).repartition(key)
    used = F.when(_usable(config), F.length("_said") + 1).otherwise(0)
    df = df.withColumn("_before", F.coalesce(F.sum(used).over(within), F.lit(0)))
    said = F.when(_usable(config) & (F.col("_before") <= config.max_context_tokens + 1), F.struct(F.col("pos").alias("p"), F.col("_page").alias("g"), F.left("_said", F.lit(config.max_context_tokens + 1)).alias("s")))
    df = df.withColumn("_near", F.collect_list(said).over(frame)).where(F.col("type") != "text" if of is None else of)
    marked = F.transform(F.array_sort("_near"), lambda x: F.when(x["g"] == F.col("_page"), x["s"]).otherwise(F.concat(F.lit("[Page "), x["g"].cast("string"), F.lit("] "), x["s"])))
    return df.withColumn("context", truncate(F.array_join(marked, "\n"), config.max_context_tokens)).drop("_page", "_said", "_before", "_near")


def chunk_context(blocks: DataFrame, config: Config = DEFAULT, key: str = "doc_id", of: Column | None = None) -> DataFrame:
    """blocks with context: texts at most context_window positions away, not their own."""
    frame = W.partitionBy(key).orderBy("pos").rowsBetween(-config.context_window, config.context_window)
    said = F.when(_usable(config), F.struct(F.col("pos").alias("p"), F.col("_said").alias("s")))
    df = blocks.withColumn("_said", item_text(config)).withColumn("_near", F.collect_list(said).over(frame))
    df = df.where(F.col("type") != "text" if of is None else of)
    others = F.transform(F.filter(F.array_sort("_near"), lambda x: x["p"] != F.col("pos")), lambda x: x["s"])
    return df.withColumn("context", truncate(F.array_join(others, "\n"), config.max_context_tokens)).drop("_said", "_near")


def texts_context(chunks: Column | str, index: Column, config: Config = DEFAULT) -> Column:
    """The same within an array of texts: only the window's are read."""
    w, c = config.context_window, F.col(chunks) if isinstance(chunks, str) else chunks
    first = F.greatest(index - w, F.lit(0))
    near = F.transform(F.slice(c, first + 1, index + w + 1 - first), lambda x, i: F.when(i + first != index, strip(x)))
    return truncate(F.array_join(F.filter(near, lambda x: x.isNotNull() & (x != "")), "\n"), config.max_context_tokens)


def map_context(source: Column | str, config: Config = DEFAULT) -> Column:
    """Of a map: its content, else its text, else all its values."""
    m = F.col(source) if isinstance(source, str) else source
    return truncate(F.coalesce(m["content"], m["text"], F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: e["value"]), "\n"), F.lit("")), config.max_context_tokens)


def any_context(kind: str, source: Column, index: Column, config: Config = DEFAULT) -> Column:
    """Of a source that isn't blocks: an array of texts, a map or a text."""
    if kind == "texts":
        return texts_context(source, index, config)
    if kind == "map":
        return map_context(source, config)
    if kind == "text":
        return truncate(F.coalesce(source, F.lit("")), config.max_context_tokens)
    raise ValueError(f"no kind of source {kind}; there are texts, map, text")
