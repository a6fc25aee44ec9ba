"""Vectors beside chunks, kept by content: a text is embedded once for each model, however often and wherever it occurs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..joins import spread_join
from ..shared import durable
from .tables import KeyedTable

BATCH_TOKENS, BATCH_TEXTS = 8192, 256


def vector_store(spark: SparkSession, folder: str) -> KeyedTable:
    """hash (md5 of the content), model, embedding."""
    return KeyedTable(spark, folder, ["hash", "model"])


def packs(rows: Iterator[tuple[str, str, int]], most: int, texts: int) -> Iterator[list[tuple[str, str]]]:
    """Rows (hash, content, tokens) in lists of at most so many tokens and texts, or of one text."""
    held, sum_ = [], 0
    for h, content, n in rows:
        if held and (sum_ + n > most or len(held) == texts):
            yield held
            held, sum_ = [], 0
        held.append((h, content))
        sum_ += n
    if held:
        yield held


def embedded(chunks: DataFrame, store: KeyedTable, load: Callable, dim: int, model: str, most: int = BATCH_TOKENS, texts: int = BATCH_TEXTS, size: Callable[[Column], Column] = tokens) -> DataFrame:
    """chunks (content and any other columns) with hash, model, embedding (norm 1, or 0 of a zero vector), and whether it was added now.

    Contents that the store lacks are embedded, each once, in calls packed by tokens, and put into the store before anything
    reads them; all chunks then read the store. A null content has no vector. A model that gives another length is an error."""
    hashed = chunks.withColumn("hash", F.md5("content"))
    wanted = hashed.where("hash is not null").groupBy("hash").agg(F.any_value("content").alias("content"), F.count("*").alias("n"))
    wanted = durable(wanted.select("hash", F.lit(model).alias("model"), "content", "n", size(F.col("content")).alias("tokens")))
    known = store.lookup(wanted)
    new = wanted.withColumn("added", F.lit(True)) if known is None else wanted.join(known.select("hash", "model"), ["hash", "model"], "left_anti")

    def run(batches):
        call = load()
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("hash", "content", "tokens")), strict=True)
            for pack in packs(rows, most, texts):
                m = np.asarray(call([t for _, t in pack]), np.float32)
                if m.shape != (len(pack), dim):
                    raise ValueError(f"the model gave vectors of shape {m.shape[1:]}, not {dim}")
                n = np.linalg.norm(m, axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in pack]), pa.array((m / np.where(n > 0, n, 1)).tolist(), pa.list_(pa.float32()))], names=["hash", "embedding"])

    made = new.select("hash", "content", "tokens").mapInArrow(run, "hash string, embedding array<float>")
    before = store.manifest()
    store.upsert(made.select("hash", F.lit(model).alias("model"), "embedding"))
    vectors = store.lookup(wanted)
    if before is None:
        vectors = vectors.withColumn("added", F.lit(True))
    else:
        old = store.read(before["version"]).select("hash", "model", F.lit(False).alias("old"))
        vectors = vectors.join(old, ["hash", "model"], "left").withColumn("added", F.coalesce("old", F.lit(True))).drop("old")
    by = vectors.join(wanted.select("hash", "n"), "hash").select("hash", "model", "embedding", "added", "n")
    out = spread_join(hashed.where("hash is not null"), by, ["hash"], chunks.count())
    none = hashed.where("hash is null").select("*", F.lit(model).alias("model"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(False).alias("added"))
    return out.unionByName(none)
