"""Keyed tables on plain files: rows in a fixed number of hash buckets, a manifest that names each bucket's folder.

An upsert reads and writes only the buckets that its keys fall into; all others stay as they are and are named again by
the new manifest. A manifest has one entry for each bucket and is never changed: a new one is a commit, made by claiming the
version it follows (a file that only one writer can create) and renaming it into place. Whoever reads keeps the version
that it began with; a write that fails leaves the last one. vacuum() removes what no kept version names."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .status import latest

BUCKETS, STALE_SECONDS = 64, 3600.0


class Conflict(Exception):
    """Another writer committed first, or is about to."""


class KeyedTable:
    """A table below folder. keys, which aren't null, and buckets are fixed by its first commit."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), keys, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        if (m := self.manifest()) and m["keys"] != keys:
            raise ValueError(f"the table's keys are {m['keys']}")
        self.buckets = m["buckets"] if m else buckets

    def versions(self) -> list[int]:
        root = self._path(f"{self.folder}/manifests")
        return sorted(int(s.getPath().getName()[:-5]) for s in self._fs.listStatus(root) if s.getPath().getName().endswith(".json")) if self._fs.exists(root) else []

    def manifest(self, version: int | None = None) -> dict | None:
        """keys, buckets, schema, and the folder of each bucket that has rows; of the latest version by default."""
        known = self.versions()
        if not known:
            return None
        version = known[-1] if version is None else version
        found = json.loads(self.spark.read.text(f"{self.folder}/manifests/{version:09d}.json", wholetext=True).first()[0])
        return {**found, "version": version}

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame | None:
        """The rows of a version, or of some of its buckets; None before the first commit."""
        m = self.manifest(version)
        return m and self._rows(m, only)

    def _rows(self, m: dict, only: list[int] | None = None) -> DataFrame:
        paths = [f"{self.folder}/{p}" for b, p in m["folders"].items() if only is None or int(b) in only]
        return self.spark.read.schema(m["schema"]).parquet(*paths) if paths else self.spark.createDataFrame([], m["schema"])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def lookup(self, wanted: DataFrame) -> DataFrame | None:
        """The rows whose keys are in wanted; only their buckets are read."""
        rows = self.read(only=self._touched(wanted.select(*self.keys)))
        return rows and rows.join(wanted.select(*self.keys).distinct(), self.keys, "left_semi")

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect()]  # as many as there are buckets at most

    def upsert(self, new: DataFrame, many: bool = False, combine: dict[str, Callable[[Column, Column], Column]] | None = None) -> int:
        """A version in which new's rows stand in place of those of their keys. Of new's rows of one key the one of highest
        _pos counts, or with many all do. combine: columns made of the old value (null without one) and the new. Returns the version."""
        m = self.manifest()
        base = m["version"] if m else -1
        if "_pos" in new.columns:
            new = new.drop("_pos") if many else latest(new, self.keys, "_pos").drop("_pos")
        folder, names = f"data/{uuid.uuid4()}", [c for c in new.columns]
        staged = f"{self.folder}/{folder}-new"
        # what comes in is computed once, dealt like the table
        new.withColumn("_bucket", self.bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(staged)
        parts = self._fs.listStatus(self._path(staged))
        touched = [int(s.getPath().getName().split("=")[1]) for s in parts if s.getPath().getName().startswith("_bucket=")]
        if not touched:
            self._delete(staged)
            return base if m else self._commit(-1, {}, new)
        given = self.spark.read.parquet(staged)
        out = given.select(*names, "_bucket")
        if m:
            old = self._rows(m, touched)
            if combine:
                before = old.select(*self.keys, *(F.col(c).alias(f"_old_{c}") for c in combine))
                joined = given.join(before, self.keys, "left")
                out = joined.select(*(combine[c](F.col(f"_old_{c}"), F.col(c)).alias(c) if c in combine else F.col(c) for c in names), "_bucket")
            kept = old.join(given.select(*self.keys).distinct(), self.keys, "left_anti").withColumn("_bucket", self.bucket())
            out = out.unionByName(kept, allowMissingColumns=True)
        elif combine:
            out = out.select(*(combine[c](F.lit(None).cast(new.schema[c].dataType), F.col(c)).alias(c) if c in combine else F.col(c) for c in names), "_bucket")
        out.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/{folder}")
        self._delete(staged)
        schema = out.drop("_bucket")
        return self._commit(base, {**(m["folders"] if m else {}), **{str(b): f"{folder}/_bucket={b}" for b in touched}}, schema)

    def delete(self, gone: DataFrame) -> int | None:
        """A version without the rows of gone's keys; their buckets are written anew."""
        m = self.manifest()
        if m is None:
            return None
        touched = self._touched(gone.select(*self.keys))
        kept = self._rows(m, touched).join(gone.select(*self.keys).distinct(), self.keys, "left_anti")
        folder = f"data/{uuid.uuid4()}"
        kept.withColumn("_bucket", self.bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/{folder}")
        left = {s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/{folder}"))}
        folders = {b: p for b, p in m["folders"].items() if int(b) not in touched}
        folders |= {str(b): f"{folder}/_bucket={b}" for b in touched if f"_bucket={b}" in left}
        return self._commit(m["version"], folders, kept)

    def _commit(self, base: int, folders: dict[str, str], rows: DataFrame) -> int:
        claim = self._path(f"{self.folder}/claims/{base + 1:09d}")
        self._fs.mkdirs(claim.getParent())
        if self._fs.exists(claim) and not self._made(base + 1) and time.time() - self._fs.getFileStatus(claim).getModificationTime() / 1000 > STALE_SECONDS:
            self._fs.delete(claim, False)  # of a writer that died before it committed
        if self._made(base + 1) or not self._fs.createNewFile(claim):
            raise Conflict(f"version {base + 1} has another writer; read it and try again")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        said = json.dumps({"keys": self.keys, "buckets": self.buckets, "schema": schema, "folders": dict(sorted(folders.items(), key=lambda x: int(x[0])))})
        draft, final = self._path(f"{self.folder}/manifests/.{uuid.uuid4()}"), self._path(f"{self.folder}/manifests/{base + 1:09d}.json")
        out = self._fs.create(draft, True)
        out.write(said.encode())
        out.close()
        if not self._fs.rename(draft, final):
            raise Conflict(f"version {base + 1} is there already")
        return base + 1

    def _made(self, version: int) -> bool:
        return self._fs.exists(self._path(f"{self.folder}/manifests/{version:09d}.json"))

    def _delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def vacuum(self, keep: int = 2) -> None:
        """Removes versions before the last keep, and folders that none of the kept names. No writer may be at work."""
        known = self.versions()
        named = {p for v in known[-keep:] for p in self.manifest(v)["folders"].values()}
        for v in known[:-keep]:
            self._delete(f"{self.folder}/manifests/{v:09d}.json")
        root = self._path(f"{self.folder}/data")
        for s in self._fs.listStatus(root) if self._fs.exists(root) else []:
            folder = f"data/{s.getPath().getName()}"
            parts = [p.getPath().getName() for p in self._fs.listStatus(s.getPath()) if p.getPath().getName().startswith("_bucket=")]
            used = [p for p in parts if f"{folder}/{p}" in named]
            if not used:
                self._delete(f"{self.folder}/{folder}")
            for p in parts:
                if used and p not in used:
                    self._delete(f"{self.folder}/{folder}/{p}")
