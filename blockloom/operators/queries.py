"""Multimodal queries: descriptions, enhanced texts, cache keys, images between texts."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, strip

#: Texts around a query.
SUFFIX = "\n\nPlease provide a comprehensive answer based on the user query and the provided multimodal content information."
SYSTEM = "You are a helpful assistant that can analyze both text and image content to provide comprehensive answers."
CLOSING = "\n\nUser Question: {}\n\nPlease answer based on the context and images provided."
#: Options of a parser that bear on what it gives.
PARSE_OPTIONS = ("lang", "device", "start_page", "end_page", "formula", "table", "backend", "source")
KEPT_OPTIONS = ("stream", "response_type", "top_k", "max_tokens", "temperature", "system_prompt")
LONG = 200
_IMAGE = re.compile(r"Image Path:\s*([^\r\n]*?\.(?:jpg|jpeg|png|gif|bmp|webp|tiff|tif))")


def options(x: Column | str, kept: tuple[str, ...] = KEPT_OPTIONS) -> Column:
    """A map's entries that bear on the answer, or are of other kept names."""
    return F.map_filter(x, lambda k, v: k.isin(*kept))


def normal_item(item: Column) -> Column:
    """A query's item (struct type, img_path, table_body, text) with paths cut to names and long tables to their hashes."""
    long = F.length(item["table_body"]) > LONG
    return F.struct(
        item["type"].alias("type"), basename(item["img_path"]).alias("img_path"), F.when(~long, item["table_body"]).alias("table_body"), F.when(long, F.md5(item["table_body"])).alias("table_body_hash"), item["text"].alias("text"),
    )


def cache_key(query: Column, items: Column, mode: Column, kept: Column | None = None) -> Column:
    """A key that stays the same for the same question, whatever folder its files are in."""
    parts = [strip(query).alias("query"), mode.alias("mode"), F.transform(items, normal_item).alias("items")]
    if kept is not None:
        parts.append(F.array_sort(F.map_entries(kept)).alias("options"))
    return F.concat(F.lit("multimodal_query:"), F.md5(F.to_json(F.struct(*parts))))


def parse_key(path: Column, mtime: Column, parser: Column, method: Column, given: Column | None = None) -> Column:
    """A key of what a file's parse depends on. given: a map of the parser's options, of which PARSE_OPTIONS count, in any order; without any of these the key is as without options."""
    parts = [path, mtime.cast("string"), parser, method]
    if given is not None:
        kept = F.array_sort(F.map_entries(options(given, PARSE_OPTIONS)))
        parts.append(F.when(F.size(kept) > 0, F.to_json(kept)))
    return F.md5(F.concat_ws("|", *parts))


def described_image(path: Column, captions: Column, footnotes: Column) -> Column:
    """What is known of an image that can't be read."""
    join = lambda x: F.nullif(F.array_join(F.coalesce(x, F.expr("cast(array() as array<string>)")), ", "), F.lit(""))
    said = F.concat_ws("; ", F.concat(F.lit("Image path: "), F.nullif(path, F.lit(""))), F.concat(F.lit("Image captions: "), join(captions)), F.concat(F.lit("Image footnotes: "), join(footnotes)))
    return F.coalesce(F.nullif(said, F.lit("")), F.lit("Image content information incomplete"))


#: What a model is asked about an item that comes with a question, by the item's type.
ITEM_PROMPTS = {
    "table": "Describe this table for a reader who can't see it: structure, main figures, trends.\n\nTable:\n{table_body}",
    "equation": "Explain this equation: its symbols, its meaning and what it is used for.\n\nEquation: {text}",
    "generic": "Describe this content of type {type}: what it is and what matters in it.\n\nContent: {content}",
}


def item_prompt(item: Column) -> Column:
    """What a model is asked about an item (struct type, img_path, table_body, text); null for images, of which paths and captions tell."""
    from .chunks import fill

    of = dict(table_body=item["table_body"], text=item["text"], type=item["type"], content=F.coalesce(item["text"], item["table_body"]))
    return F.when(item["type"] == "image", F.lit(None).cast("string")).when(item["type"] == "table", fill(ITEM_PROMPTS["table"], **of)).when(item["type"] == "equation", fill(ITEM_PROMPTS["equation"], **of)).otherwise(fill(ITEM_PROMPTS["generic"], **of))


def enhanced(query: Column, items: Column) -> Column:
    """A query with its items' descriptions (array of struct type, description), those without one left out."""
    told = F.transform(F.filter(items, lambda i: i["description"].isNotNull()), lambda i: F.concat(F.lit("\nRelated "), i["type"], F.lit(" content: "), i["description"]))
    return F.concat(F.array_join(F.concat(F.array(F.concat(F.lit("User query: "), query)), told), "\n"), F.lit(SUFFIX))


def marked(prompt: Column, readable: Column) -> Column:
    """A prompt with a numbered marker after each path to an image that is in readable (array), and those paths in order."""

    @F.arrow_udf("struct<prompt:string,images:array<string>>")
    def run(prompts: pa.Array, readables: pa.Array) -> pa.Array:
        out = []
        for p, ok in zip(prompts.to_pylist(), readables.to_pylist(), strict=True):
            images, known = [], set(ok or ())

            def mark(m, images=images, known=known):
                path = m[1].strip()
                if len(path) < 3 or path not in known:
                    return m[0]
                images.append(path)
                return f"Image Path: {path}\n[VLM_IMAGE_{len(images)}]"

            out.append(None if p is None else {"prompt": _IMAGE.sub(mark, p), "images": images})
        return pa.array(out, pa.struct([("prompt", pa.string()), ("images", pa.list_(pa.string()))]))

    return run(prompt, readable)


def readable_images(prompt: Column, folders: list[str]) -> Column:
    """The paths that a prompt names as images and that lie, normalised, in one of some folders."""
    from ..sources.files import below

    found = F.regexp_extract_all(prompt, F.lit(_IMAGE.pattern), 1)
    return F.array_distinct(F.filter(F.transform(found, strip), lambda p: below(p, folders)))


def vision_messages(df: DataFrame, prompt: str, question: str, folders: list[str], system: Column | None = None) -> DataFrame:
    """df with system, parts, images for a vision model: a retrieved prompt with its safe images between its texts. Without such images the parts are the prompt and the question as one text."""
    p, q = F.col(prompt), F.col(question)
    # a generator of one row keeps the Python function out of the expressions over its result
    m = df.withColumn("_m", F.explode(F.array(marked(p, readable_images(p, folders)))))
    plain = F.array(F.struct(F.lit("text").alias("type"), F.concat(F.lit("Context:\n"), p, F.lit("\n\nUser Question: "), q).alias("text"), F.lit(None).cast("int").alias("image")))
    parts = F.when(F.size("_m.images") > 0, messages(F.col("_m.prompt"), F.col("_m.images"), q)).otherwise(plain)
    return m.withColumns({"system": F.lit(SYSTEM) if system is None else F.concat(F.lit(SYSTEM + " "), system), "parts": parts, "images": F.col("_m.images")}).drop("_m")


def messages(prompt: Column, images: Column, question: Column) -> Column:
    """The parts of a message: texts between markers, images (by number from 0) at them, then the question. Markers of no image go."""
    pieces = F.split(prompt, r"\[VLM_IMAGE_")
    number = lambda p: F.try_element_at(F.split(p, "]", 2), F.lit(1)).try_cast("int")
    part = lambda kind, text, at: F.struct(F.lit(kind).alias("type"), text.alias("text"), at.cast("int").alias("image"))
    none_text, none_at = F.lit(None).cast("string"), F.lit(None).cast("int")
    body = F.flatten(
        F.transform(
            pieces,
            lambda p, i: F.when(i == 0, F.array(part("text", p, none_at))).otherwise(
                F.array(part("image", none_text, F.when((number(p) >= 1) & (number(p) <= F.size(images)), number(p) - 1)), part("text", F.try_element_at(F.split(p, "]", 2), F.lit(2)), none_at))
            ),
        )
    )
    kept = F.filter(body, lambda x: F.coalesce(strip(x["text"]) != "", F.lit(False)) | x["image"].isNotNull())
    before, after = CLOSING.split("{}")
    return F.concat(kept, F.array(part("text", F.concat(F.lit(before), question, F.lit(after)), none_at)))
