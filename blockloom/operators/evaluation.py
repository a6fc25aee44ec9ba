"""Evaluation of answers: scores by method, document and kind, error summaries, pending and replaced results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = ("relevance", "completeness", "faithfulness", "clarity", "consistency", "overall_score")
KEYS = ("doc_id", "question", "method")
MODES = ("vlm", "hybrid", "mix", "naive")
PRECISION = 6


def by(results: DataFrame, *keys: str) -> DataFrame:
    """keys, n_evaluated, n_correct, accuracy (per cent) over results with an accuracy."""
    return results.where("accuracy is not null").groupBy(*keys).agg(F.count("*").alias("n_evaluated"), F.sum("accuracy").cast("long").alias("n_correct"), F.round(F.avg("accuracy") * 100, PRECISION).alias("accuracy"))


def dimensions(results: DataFrame, *keys: str) -> DataFrame:
    """Means of the further scores, each over the rows that have it; only of groups that have any relevance."""
    means = [F.round(F.avg(d), PRECISION).alias(d) for d in DIMENSIONS]
    return results.groupBy(*keys).agg(*means, F.count("relevance").alias("_n")).where("_n > 0").drop("_n")


def comparison(results: DataFrame) -> DataFrame:
    """Scores of all methods side by side, 0 for none; nothing unless there are two methods."""
    methods = results.groupBy("method").agg(F.count("accuracy").alias("n_evaluated"), *(F.round(F.coalesce(F.avg(c), F.lit(0.0)), PRECISION).alias(c) for c in ("accuracy", *DIMENSIONS)))
    several = results.agg(F.countDistinct("method").alias("m")).where("m > 1").select(F.lit(1).alias("_k"))
    return methods.withColumn("_k", F.lit(1)).join(F.broadcast(several), "_k", "left_semi").drop("_k")  # one row


def by_document(results: DataFrame) -> DataFrame:
    """by() for each document and method, with how many methods the document has."""
    from pyspark.sql import Window as W

    return by(results, "doc_id", "method").withColumn("n_methods", F.count("*").over(W.partitionBy("doc_id")))


def doc_type(name: Column | str, sources: Column | str) -> Column:
    n, s = F.lower(name), F.lower(sources)
    return (
        F.when(F.contains(s, F.lit("arxiv")), "Academic paper")
        .when(F.contains(n, F.lit("10k")), "Financial report")
        .when(n.rlike("manual|guide|handbook"), "Manual / guide")
        .when(n.rlike("report|survey"), "Research report")
        .otherwise("Other")
    )


def by_doc_type(results: DataFrame) -> DataFrame:
    """Documents' accuracies, then their means by kind; a document of several kinds counts for the kinds joined."""
    docs = results.where("accuracy is not null").groupBy("doc_id").agg(F.avg("accuracy").alias("a"), F.array_join(F.sort_array(F.collect_set(doc_type("doc_id", "evidence_sources"))), ", ").alias("doc_type"))
    return docs.groupBy("doc_type").agg(F.count("*").alias("n_documents"), F.round(F.avg("a") * 100, PRECISION).alias("accuracy"))


def folder_number(doc_id: Column | str) -> Column:
    """The number before the first slash, 10**9 without one."""
    d = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.regexp_extract(d, "^([0-9]+)/", 1).try_cast("long"), F.lit(10**9))


def pending(wanted: DataFrame, results: DataFrame) -> DataFrame:
    """Questions without a successful evaluation that has an accuracy."""
    return wanted.join(results.where("success and accuracy is not null").select(*KEYS).distinct(), list(KEYS), "left_anti")


def existing(wanted: DataFrame, results: DataFrame) -> DataFrame:
    return wanted.join(results.where("success and accuracy is not null").select(*KEYS).distinct(), list(KEYS), "left_semi")


def replaced(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """new, and those of old whose keys aren't in it."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def _failed(mode: str) -> Column:
    r = F.col(f"{mode}_result")
    return F.coalesce(r.isNotNull() & ((F.coalesce(r["error"], F.lit("")) != "") | ~F.coalesce(r["success"], F.lit(True))), F.lit(False))


def has_error() -> Column:
    """Of rows with error and one struct (success, error) for each mode."""
    return reduce(lambda a, b: a | b, map(_failed, MODES), F.coalesce(F.col("error"), F.lit("")) != "")


def error_summary() -> Column:
    """What failed, modes in order; long messages cut."""
    cut = lambda label, message: F.concat(F.lit(f"{label}: "), F.left(message, F.lit(50)), F.lit("..."))
    top = F.nullif(F.col("error"), F.lit(""))
    parts = [F.when(F.contains(F.lower(top), F.lit("document not found")), "Document not found").when(top.isNotNull(), cut("Top-level error", top))]
    for mode in MODES:
        label = "VLM" if mode == "vlm" else mode.title()
        message = F.coalesce(F.col(f"{mode}_result.error"), F.lit(f"{label} query failed"))
        told = cut(f"{label} error", message)
        if mode == "vlm":
            told = F.when(F.contains(message, F.lit("context_length_exceeded")), "VLM token limit exceeded").otherwise(told)
        parts.append(F.when(_failed(mode), told))
    return F.coalesce(F.nullif(F.concat_ws("; ", *parts), F.lit("")), F.lit("Unknown error"))


def totals(results: DataFrame) -> DataFrame:
    """One row: total, success, failed, mean time of successes; none without a success."""
    return results.agg(F.count("*").alias("total"), F.count_if("success").alias("succeeded"), F.count_if(~F.coalesce("success", F.lit(False))).alias("failed"), F.round(F.avg(F.when(F.col("success"), F.col("evaluation_time"))), PRECISION).alias("mean_time")).where("succeeded > 0")


def unpivoted(results: DataFrame) -> DataFrame:
    """One row for each mode that has a result."""
    rows = F.array(*(F.struct(F.lit(m).alias("method"), F.col(f"{m}_result").alias("r")) for m in MODES))
    return results.select("doc_id", "question", F.inline(rows)).where("r is not null").select("doc_id", "question", "method", "r.success", "r.error")
