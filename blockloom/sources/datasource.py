"""A data source for Spark's reader: spark.read.format("blockloom") parses the files of a folder to blocks.

    spark.dataSource.register(source_of({"own": read}))          # read: from a file's bytes and path to its blocks
    spark.read.format("blockloom").option("parser", "own").load(folder).where("path like ...")

Options: parser (a registered name; by default the kind that a file's extension routes to), partitionBytes, maxPartitions,
recursive. The driver lists the folder, a directory at a time, and packs files into partitions by bytes; filters on path and
mtime are applied to the listing, so what they exclude is never opened. A partition's files are kept compressed, and there
are maxPartitions at most: beyond, partitions take more bytes. Executors read and parse file by file. A file that can't be
parsed is one row with its error. The parser "output" reads what an external parser left: for each document its content list is looked for by
the document's stem, and images' paths are made absolute where they lie within the folder of that list."""

from __future__ import annotations

import json
import pickle
import posixpath
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import datasource as D

from ..config import HTML, IMAGE, OFFICE, PDF, TEXT

Read = Callable[[bytes, str], list[dict]]
SCHEMA = "path string, mtime timestamp, parser string, pos int, type string, text_level int, text string, img_path string, captions array<string>, table_body string, page_idx int, error string"
PARTITION_BYTES, OPEN_BYTES = 32 << 20, 1 << 20  # a file costs OPEN_BYTES at least
MAX_PARTITIONS = 4_096
BATCH_ROWS, BATCH_CHARS = 1_024, 1 << 20  # files' rows go on together when either is reached; a file's are never parted
#: Where a parser leaves the list of a document, below its output folder; {} is the document's stem.
LISTS = ("{0}/{1}/{0}_content_list.json", "{0}/{0}_content_list.json", "{0}_content_list.json")
METHODS = ("auto", "ocr", "txt", "vlm", "hybrid_auto")


def opened(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if re.match(r"^[a-z][a-z0-9+.-]+:", path) and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)


def routed(path: str) -> str:
    """Which kind of parser a file goes to by its extension (as sources.files.route)."""
    ext = posixpath.splitext(path)[1].lower()
    return next((kind for kind, exts in (("pdf", PDF), ("image", IMAGE), ("office", OFFICE), ("text", TEXT), ("html", HTML)) if ext in exts), "generic")


def output_list(system, folder: str, stem: str, method: str | None = None) -> str | None:
    """The content list that a parser left for a document, the method's own first."""
    from pyarrow import fs

    methods = [method] if method else METHODS
    tried = [f"{folder}/{LISTS[0].format(stem, m)}" for m in methods] + [f"{folder}/{x.format(stem)}" for x in LISTS[1:]]
    found = system.get_file_info(tried)
    return next((p for p, i in zip(tried, found, strict=True) if i.type == fs.FileType.File), None)


def absolute(path: str | None, base: str) -> str | None:
    """An image's path below base; empty if it leads elsewhere, as a list isn't trusted with the file system."""
    if not path:
        return path
    full = posixpath.normpath(path if path.startswith("/") else f"{base}/{path}")
    return full if full.startswith(base.rstrip("/") + "/") else ""


def listed_blocks(raw: bytes, base: str) -> list[dict]:
    """The blocks of a content list; lists in it are laid open by one level, other things than objects left out."""
    items = json.loads(raw)
    if not isinstance(items, list):
        raise ValueError("no list of blocks")
    flat = [y for x in items for y in (x if isinstance(x, list) else [x]) if isinstance(y, dict)]
    out = []
    for b in flat:
        kind = b.get("type") or "text"
        captions = b.get(f"{kind}_caption") or b.get("captions") or []
        body = b.get("table_body")
        out.append({
            "type": kind, "text": b.get("text") if b.get("text") is not None else b.get("latex"), "text_level": b.get("text_level"), "img_path": absolute(b.get("img_path"), base),
            "captions": [str(c) for c in captions] if isinstance(captions, list) else [str(captions)], "table_body": body if isinstance(body, str) or body is None else json.dumps(body), "page_idx": b.get("page_idx"),
        })
    return out


@dataclass
class Packed(D.InputPartition):
    """Some files: path, size, time in microseconds; compressed, as the driver holds all partitions."""

    pieces: list[bytes]

    @property
    def files(self) -> list[tuple[str, int, int]]:
        return list(self.unpacked())

    def unpacked(self) -> Iterator[tuple[str, int, int]]:
        for x in self.pieces:
            yield from zip(*pickle.loads(zlib.decompress(x)), strict=True)


def piece(files: list[tuple[str, int, int]]) -> bytes:
    return zlib.compress(pickle.dumps(tuple(zip(*files, strict=True))))


def packed(files: Iterable[tuple[str, int, int]], limit: int, most: int = MAX_PARTITIONS) -> list[Packed]:
    """Files in the order given in partitions of about limit bytes; with more than most of them, of twice, four times and so on."""
    out, own, held = [], [], 0
    for f in files:
        cost = max(f[1], OPEN_BYTES)
        if own and held + cost > limit:
            out.append(Packed([piece(own)]))
            own, held = [], 0
            if len(out) > most:
                out, limit = paired(out), limit * 2
        own.append(f)
        held += cost
    if own:
        out.append(Packed([piece(own)]))
    return paired(out) if len(out) > most else out


def paired(parts: list[Packed]) -> list[Packed]:
    return [Packed([x for p in parts[k : k + 2] for x in p.pieces]) for k in range(0, len(parts), 2)]


def listed(system, folder: str, recursive: bool = True) -> Iterator[tuple[str, int, int]]:
    """Files below a folder, by name within each directory; one directory's are held at a time. What is hidden is neither given nor entered."""
    from pyarrow import fs

    left = [folder]
    while left:
        found = sorted((i for i in system.get_file_info(fs.FileSelector(left.pop())) if not i.base_name.startswith(("_", "."))), key=lambda i: i.base_name)
        if recursive:
            left.extend(i.path for i in reversed(found) if i.type == fs.FileType.Directory)
        yield from ((i.path, i.size or 0, int(i.mtime.timestamp() * 1e6) if i.mtime else 0) for i in found if i.type == fs.FileType.File)


class BlockReader(D.DataSourceReader):
    def __init__(self, options: dict, readers: dict[str, Read]) -> None:
        self.folder = options.get("path")
        if not self.folder:
            raise ValueError("a folder to load is needed")
        self.parser = (options.get("parser") or "").strip().lower() or None
        if self.parser not in {None, "output", *readers}:
            raise ValueError(f"no parser {self.parser}; there are {', '.join(sorted({'output', *readers}))}")
        self.limit = int(options.get("partitionbytes") or options.get("partitionBytes") or PARTITION_BYTES)
        self.most = int(options.get("maxpartitions") or options.get("maxPartitions") or MAX_PARTITIONS)
        self.recursive = (options.get("recursive") or "true").lower() == "true"
        self.output, self.method, self.readers = options.get("output"), options.get("method"), readers
        self.tests: list[Callable[[str, datetime], bool]] = []

    def pushFilters(self, filters: list) -> Iterator:
        """Filters on path and mtime are this source's; the others stay Spark's."""
        pick = {("path",): lambda p, t: p, ("mtime",): lambda p, t: t}
        compare = {D.EqualTo: lambda a, b: a == b, D.GreaterThan: lambda a, b: a > b, D.GreaterThanOrEqual: lambda a, b: a >= b, D.LessThan: lambda a, b: a < b, D.LessThanOrEqual: lambda a, b: a <= b, D.In: lambda a, b: a in b,
                   D.StringStartsWith: lambda a, b: a.startswith(b), D.StringEndsWith: lambda a, b: a.endswith(b), D.StringContains: lambda a, b: b in a}
        for f in filters:
            get, test = pick.get(getattr(f, "attribute", None)), compare.get(type(f))
            if get and test and not (get is pick["mtime",] and test in (compare[D.StringStartsWith],)):
                self.tests.append(lambda p, t, get=get, test=test, value=f.value: test(get(p, t), value))
            elif isinstance(f, D.IsNotNull) and getattr(f, "attribute", None) in pick:
                continue  # they never are
            else:
                yield f

    def partitions(self) -> list[Packed]:
        system, folder = opened(self.folder)
        files = (f for f in listed(system, folder, self.recursive) if all(t(f[0], _time(f[2])) for t in self.tests))
        return packed(files, self.limit, self.most) or [Packed([])]

    def read(self, partition: Packed) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.folder)
        out, held = [], 0
        for path, _, time in partition.unpacked():
            name = self.parser or routed(path)
            try:
                rows = [{"pos": k, **b, "type": b.get("type") or "text", "text_level": b.get("text_level") or 0, "page_idx": b.get("page_idx") or 0, "error": None} for k, b in enumerate(self._blocks(system, path, name))]
            except Exception as e:
                rows = [{"error": f"{type(e).__name__}: {e}"}]
            out += [{"path": path, "mtime": _time(time), "parser": name, **r} for r in rows]
            held += sum(len(r.get("text") or "") + len(r.get("table_body") or "") for r in rows)
            if len(out) >= BATCH_ROWS or held >= BATCH_CHARS:
                yield pa.RecordBatch.from_pylist(out, ARROW)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, ARROW)

    def _blocks(self, system, path: str, name: str) -> list[dict]:
        content = lambda p: system.open_input_stream(p).readall()
        if name == "output":
            found = output_list(system, opened(self.output)[1] if self.output else posixpath.dirname(path), posixpath.splitext(posixpath.basename(path))[0], self.method)
            if found is None:
                raise FileNotFoundError("no content list for it")
            return listed_blocks(content(found), posixpath.dirname(found))
        if name not in self.readers:
            raise LookupError(f"no parser {name}")
        return self.readers[name](content(path), path)


def _time(micros: int) -> datetime:
    return datetime.fromtimestamp(micros / 1e6, UTC)


ARROW = pa.schema([("path", pa.string()), ("mtime", pa.timestamp("us", "UTC")), ("parser", pa.string()), ("pos", pa.int32()), ("type", pa.string()), ("text_level", pa.int32()), ("text", pa.string()), ("img_path", pa.string()),
                   ("captions", pa.list_(pa.string())), ("table_body", pa.string()), ("page_idx", pa.int32()), ("error", pa.string())])


def source_of(own: dict[str, Read] | None = None, name: str = "blockloom") -> type[D.DataSource]:
    """A source with the built-in parsers and some of one's own, to be registered with a session."""
    from .files import builtin_readers

    readers = {**builtin_readers(), **{k.strip().lower(): f for k, f in (own or {}).items()}}
    called = name

    class Blocks(D.DataSource):
        @classmethod
        def name(cls) -> str:
            return called

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> BlockReader:
            return BlockReader(dict(self.options), readers)

    return Blocks


def load(spark, folder: str, own: dict[str, Read] | None = None, **options: str):
    """The blocks of a folder's files, as by spark.read; filters on path and mtime reach the listing."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source_of(own))
    return spark.read.format("blockloom").options(**options).load(folder)
