"""Documents' status, batches, caches and upserts, as rows derived from rows; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename

PRECISION = 6


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of highest order for each key. Takes map-side partial results, so a key with very many rows holds up no task."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_r")).select(*keys, "_r.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's rows in place of or beside its own; of new's rows with one key the last by _pos, if it has that column."""
    new = latest(new, keys, "_pos").drop("_pos") if "_pos" in new.columns else new
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def batch_summary(files: DataFrame, *keys: str) -> DataFrame:
    """n_files, n_ok, n_failed, success_rate (per cent, 0 without files) of rows with ok."""
    n = F.count("*")
    return files.groupBy(*keys).agg(n.alias("n_files"), F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"), F.round(F.coalesce(F.try_divide(F.count_if("ok") * 100.0, n), F.lit(0.0)), PRECISION).alias("success_rate"))


def projection(wanted: DataFrame, status: DataFrame, key: str = "doc_id") -> DataFrame:
    """For every wanted document whether it is known, how far it is, and how many chunks it has."""
    known = status.select(F.col(key).alias("_k"), "status", "multimodal_processed", "chunks_count")
    met = wanted.join(known, F.col(key) == F.col("_k"), "left")
    text, modal = F.coalesce(F.col("status") == "processed", F.lit(False)), F.coalesce("multimodal_processed", F.lit(False))
    return met.select(key, F.col("_k").isNotNull().alias("exists"), text.alias("text_processed"), modal.alias("multimodal_processed"), (text & modal).alias("fully_processed"), F.coalesce("chunks_count", F.lit(0)).alias("chunks_count"))


def appended(old: Column, new: Column) -> Column:
    """A list of chunk ids with new ones behind."""
    none = F.expr("cast(array() as array<string>)")
    return F.concat(F.coalesce(old, none), F.coalesce(new, none))


def gate(docs: DataFrame, status: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents whose other blocks are still to be processed."""
    return docs.join(status.where("multimodal_processed").select(key), key, "left_anti")


def cache_hits(files: DataFrame, cache: DataFrame) -> DataFrame:
    """files with hit: same cache_key, and neither changed since nor configured otherwise."""
    c = cache.select("cache_key", F.col("mtime").alias("_m"), F.col("parse_config").alias("_p"))
    met = files.join(c, "cache_key", "left")
    return met.withColumn("hit", F.coalesce((F.col("_m") == F.col("mtime")) & (F.col("_p") == F.col("parse_config")), F.lit(False))).drop("_m", "_p")


def output_folder(path: Column | str) -> Column:
    """A folder's name that differs for equal names in different places."""
    stem = F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")
    return F.concat(stem, F.lit("_"), F.left(F.md5(path), F.lit(8)))


def document_status(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_status rows from chunks: the ids in order and their number."""
    return chunks.groupBy(key).agg(
        F.lit("processed").alias("status"),
        F.count("*").alias("chunks_count"),
        F.transform(F.array_sort(F.collect_list(F.struct("chunk_order_index", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunks_list"),
    )


def document_states(parsed: DataFrame, chunks: DataFrame, todo: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """key, status, error, chunks_count, multimodal_processed of every parsed document (key, error).

    failed: it couldn't be parsed, or all of its chunks (key, error) failed; ready: parsed, no chunk yet; handling: it has
    chunks, and todo (key) says that other blocks are still to come; processed: all is done. Errors: the parser's, else the first of its chunks'."""
    made = chunks.groupBy(key).agg(F.count("*").alias("chunks_count"), F.count_if(F.col("error").isNotNull()).alias("_bad"), F.min("error").alias("_why"))
    met = parsed.select(key, F.col("error").alias("_parse")).join(made, key, "left")
    if todo is None:
        met = met.withColumn("_todo", F.lit(False))
    else:
        met = met.join(todo.select(key).distinct().withColumn("_todo", F.lit(True)), key, "left").withColumn("_todo", F.coalesce("_todo", F.lit(False)))
    n, failed = F.coalesce("chunks_count", F.lit(0)), F.col("_parse").isNotNull() | ((F.col("_bad") > 0) & (F.col("_bad") == F.col("chunks_count")))
    state = F.when(failed, "failed").when(n == 0, "ready").when(F.col("_todo"), "handling").otherwise("processed")
    state = F.coalesce(state, F.lit("ready"))
    return met.select(key, state.alias("status"), F.coalesce("_parse", "_why").alias("error"), n.alias("chunks_count"), (state == "processed").alias("multimodal_processed"))
