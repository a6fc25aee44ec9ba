"""File sources: folder scans, parser registry, routing by extension, image and path checks."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import HTML, IMAGE, OFFICE, PDF, TEXT, Config
from ..functions.text import extension
from ..shared import CLEANUP

Parser = Callable[[DataFrame], DataFrame]


def extensions() -> tuple[str, ...]:
    """What the built-in routes can take."""
    return tuple(sorted({*PDF, *IMAGE, *OFFICE, *TEXT, *HTML}))


def normalise_extension(x: str) -> str:
    x = x.strip().lower()
    return x if not x or x.startswith(".") else f".{x}"


def listing(spark: SparkSession, folder: str, exts: tuple[str, ...] = (), recursive: bool = True, limit: int | None = None) -> DataFrame:
    """path, modificationTime, length of the files with one of exts in any case, in order of path; their bytes aren't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).drop("content")
    df = supported(df, tuple(map(normalise_extension, exts)) or Config().supported_extensions).orderBy("path")
    return df if limit is None else df.limit(limit)


def scan_folder(spark: SparkSession, folder: str, exts: tuple[str, ...] = (), recursive: bool = True, limit: int | None = None) -> DataFrame:
    """listing() with content. Bytes are read where they are used: nothing that holds them is sorted or shuffled; with a limit, only the chosen paths (limit of them) are sent to the scan."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    if limit is None:
        return supported(df, tuple(map(normalise_extension, exts)) or Config().supported_extensions)
    return df.join(F.broadcast(listing(spark, folder, exts, recursive, limit).select("path")), "path", "left_semi")


def written(df: DataFrame, folder: str) -> int:
    """Writes the column content, as lines, to files at the column path below folder; rows of one path become one file. Returns how many files.

    Tasks write them, each under a hidden name until it is whole, and the driver is told only how many: a table's partitionBy
    would keep every directory there. The folder must be one that executors share."""
    from .datasource import opened

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        at, made, out, n = None, None, None, 0

        def close() -> None:
            if out is not None:
                out.close()
                system.move(hidden, f"{base}/{at}")

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if path != at:
                    close()
                    inner = posixpath.dirname(f"{base}/{path}")
                    if inner != made:
                        system.create_dir(inner, recursive=True)
                        made = inner
                    hidden, at, n = f"{inner}/_{uuid.uuid4()}", path, n + 1
                    out = system.open_output_stream(hidden)
                out.write(content.as_buffer())
                out.write(b"\n")
        close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        rows = df.select("path", F.col("content").cast("binary").alias("content")).repartition("path").sortWithinPartitions("path")
        return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    finally:
        spark.conf.set(CLEANUP, before)


def supported(files: DataFrame, exts: tuple[str, ...], path: str = "path") -> DataFrame:
    return files.where(extension(path).isin(*exts))


def route(path: Column | str) -> Column:
    """Which kind of parser a file goes to."""
    ext = extension(path)
    out = F.when(ext.isin(*PDF), "pdf")
    for kind, exts in (("image", IMAGE), ("office", OFFICE), ("text", TEXT), ("html", HTML)):
        out = out.when(ext.isin(*exts), kind)
    return out.otherwise("generic")


def valid_image(path: Column | str, size: Column | str, max_mb: int = 50, symlink: Column | None = None) -> Column:
    """An image's extension, no link, and a size of max_mb at most."""
    ok = extension(path).isin(*IMAGE) & ((F.col(size) if isinstance(size, str) else size) <= max_mb << 20)
    return ok if symlink is None else ok & ~symlink


def normalised_path(path: Column | str) -> Column:
    """An absolute path without "." and ".." parts; ".." at the root is dropped."""
    p = F.col(path) if isinstance(path, str) else path
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    kept = F.aggregate(parts, F.expr("cast(array() as array<string>)"), lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def below(path: Column | str, folders: list[str]) -> Column:
    """Whether a path, normalised, lies in one of some folders."""
    p, out = normalised_path(path), F.lit(False)
    for f in folders:
        base = posixpath.normpath(f).rstrip("/")
        out = out | (p == base) | F.startswith(p, F.lit(base + "/"))
    return out


def guarded_image(path: Column | str, base: str) -> Column:
    """The path below base that a block gives, empty if it leads elsewhere."""
    p = F.col(path) if isinstance(path, str) else path
    full = F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), p))
    return F.when(below(full, [base]), normalised_path(full)).otherwise(F.lit(""))


@dataclass
class Registry:
    """Parsers by name; names are stripped and lower-cased, built-in ones can't be replaced or removed."""

    builtin: dict[str, Parser]

    def __post_init__(self) -> None:
        self.own: dict[str, Parser] = {}

    @staticmethod
    def name(x: str) -> str:
        if not isinstance(x, str) or not x.strip():
            raise ValueError("a parser needs a name")
        return x.strip().lower()

    def register(self, name: str, parser: Parser) -> None:
        if not callable(parser):
            raise TypeError("a parser is a function from files to blocks")
        if (key := self.name(name)) in self.builtin:
            raise ValueError(f"{key} is built in")
        self.own[key] = parser

    def unregister(self, name: str) -> None:
        if (key := self.name(name)) in self.builtin:
            raise ValueError(f"{key} is built in")
        self.own.pop(key)

    def get(self, name: str) -> Parser:
        key = self.name(name)
        try:
            return self.own.get(key) or self.builtin[key]
        except KeyError:
            raise ValueError(f"no parser {key}; there are {', '.join(self.names())}") from None

    def names(self) -> list[str]:
        return sorted({*self.builtin, *self.own})


#: What parsers give: one row for each file, with its blocks or an error.
PARSED = "path string, blocks array<struct<pos:int,type:string,text_level:int,text:string,img_path:string,captions:array<string>,table_body:string,page_idx:int>>, error string"


def parser_of(read: Callable[[bytes, str], list[dict]]) -> Parser:
    """A parser from a function of a file's bytes and path to its blocks (dicts with type, text and so on). A file that it
    fails on has null blocks and the error; others aren't touched by that."""
    names = ("type", "text_level", "text", "img_path", "captions", "table_body", "page_idx")
    item = pa.struct([("pos", pa.int32()), ("type", pa.string()), ("text_level", pa.int32()), ("text", pa.string()), ("img_path", pa.string()), ("captions", pa.list_(pa.string())), ("table_body", pa.string()), ("page_idx", pa.int32())])

    @F.arrow_udf("struct<blocks:array<struct<pos:int,type:string,text_level:int,text:string,img_path:string,captions:array<string>,table_body:string,page_idx:int>>,error:string>")
    def run(contents: pa.Array, paths: pa.Array) -> pa.Array:
        out = []
        for raw, path in zip(contents.to_pylist(), paths.to_pylist(), strict=True):
            try:
                found = [{"pos": k, **{n: b.get(n) for n in names}, "type": b.get("type") or "text", "page_idx": b.get("page_idx") or 0} for k, b in enumerate(read(raw, path))]
                out.append({"blocks": found, "error": None})
            except Exception as e:
                out.append({"blocks": None, "error": f"{type(e).__name__}: {e}"})
        return pa.array(out, pa.struct([("blocks", pa.list_(item)), ("error", pa.string())]))

    def parse(files: DataFrame) -> DataFrame:
        # a generator of one row keeps the Python function out of the expressions over its result
        return files.select("path", F.explode(F.array(run("content", "path"))).alias("_p")).select("path", "_p.blocks", "_p.error")

    return parse


def builtin_readers() -> dict[str, Callable[[bytes, str], list[dict]]]:
    """text: Markdown's lines; html: pages. From a file's bytes and path to its blocks."""
    from .blocks import decoded, page_blocks

    def text(raw: bytes, path: str) -> list[dict]:
        lines = (x.strip() for x in decoded(raw).split("\n"))
        return [{"text": x.lstrip("#").strip(), "text_level": len(x) - len(x.lstrip("#"))} for x in lines if x]

    def page(raw: bytes, path: str) -> list[dict]:
        return [dict(zip(("type", "text_level", "text", "img_path", "captions", "table_body"), b, strict=True)) for b in page_blocks(decoded(raw))]

    return {"text": text, "html": page}


def builtin_parsers() -> dict[str, Parser]:
    """The built-in readers as parsers; a parser's JSON list of blocks is read by blocks.content_list or sources.datasource instead."""
    return {name: parser_of(read) for name, read in builtin_readers().items()}


def dispatch(files: DataFrame, registry: Registry, parser: Column | None = None, cache: DataFrame | None = None, method: str = "auto", options: dict[str, str] | None = None) -> DataFrame:
    """path, parser, cache_key, blocks, error, cached for every file (path, modificationTime, content).

    parser: the name of each file's parser, by default the kind that its extension routes to. Files whose parser isn't
    registered have an error. options: the parsers' own, which the key holds (queries.PARSE_OPTIONS). cache: earlier rows by cache_key (path, time, parser, method and options); a hit with blocks isn't parsed again."""
    from ..operators.queries import parse_key

    given = F.create_map(*(F.lit(x) for k, v in options.items() for x in (k, str(v)))) if options else None
    named = files.withColumn("parser", F.lower(F.trim(route("path") if parser is None else parser)))
    named = named.withColumn("cache_key", parse_key(F.col("path"), F.unix_micros("modificationTime"), F.col("parser"), F.lit(method), given))
    out, todo = None, named
    if cache is not None:
        known = cache.where("blocks is not null").select("cache_key", "blocks").dropDuplicates(["cache_key"])
        out = named.drop("content").join(known, "cache_key").select("path", "parser", "cache_key", "blocks", F.lit(None).cast("string").alias("error"), F.lit(True).alias("cached"))
        todo = named.join(known.select("cache_key"), "cache_key", "left_anti")
    names = registry.names()
    for name in names:
        own = todo.where(F.col("parser") == name)
        # one row for each file: paths say which
        parsed = registry.get(name)(own.select("path", "content")).select("path", "blocks", "error")
        got = own.select("path", "parser", "cache_key").join(parsed, "path", "left").select("path", "parser", "cache_key", "blocks", F.coalesce("error", F.when(F.col("blocks").isNull(), F.lit("the parser gave nothing"))).alias("error"), F.lit(False).alias("cached"))
        out = got if out is None else out.unionByName(got)
    none = todo.where(~F.col("parser").isin(*names)).select("path", "parser", "cache_key", F.lit(None).alias("blocks"), F.concat(F.lit("no parser "), F.col("parser")).alias("error"), F.lit(False).alias("cached"))
    if out is None:
        return none
    kind = dict(out.dtypes)["blocks"]
    return out.unionByName(none.withColumn("blocks", F.col("blocks").cast(kind)))
