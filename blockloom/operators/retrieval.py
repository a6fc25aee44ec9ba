"""Retrieval: the six modes over hits by vector (operators.vectors), the graph beside them, and reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import models
from ..joins import spread_join
from .vectors import top_k  # noqa: F401

MODES = ("local", "global", "hybrid", "naive", "mix", "bypass")


def naive(hits: DataFrame) -> DataFrame:
    """query_id, chunk_id, score of chunks found by their own vectors."""
    return hits.select("query_id", F.col("vec_id").alias("chunk_id"), "score")


#: Neighbours of an entity that a search goes on to, its strongest first; of hubs there may be any number.
BESIDE = 64


def neighbours(edges: DataFrame, most: int = BESIDE) -> DataFrame:
    """entity, beside, weight, nth: each entity's strongest neighbours: by weight of the edges between them (1 each without
    weights), then by how many neighbours those have, then by name. A rank with a limit is cut in each task before it is
    shuffled, so a hub sends most rows from each."""
    w = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    both = edges.select("a", "b", w.alias("weight")).where("a <> b")
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).groupBy("a", "b").agg(F.sum("weight").alias("weight"))
    degree = both.groupBy(F.col("a").alias("b")).agg(F.count("*").alias("degree"))
    met = spread_join(both, degree.withColumn("n", F.col("degree")), ["b"], both.count())
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.desc("weight"), F.desc("degree"), "b"))
    return met.withColumn("nth", rank).where(F.col("nth") <= most).select(F.col("a").alias("entity"), F.col("b").alias("beside"), "weight", "nth")


def local(entity_hits: DataFrame, edges: DataFrame, chunks_of: DataFrame, most: int = BESIDE) -> DataFrame:
    """Entities by vector, then the strongest entities beside them by edges (a, b, weight), then the chunks of all (entity, chunk_id)."""
    hits = entity_hits.select("query_id", F.col("vec_id").alias("entity"), "score")
    beside = hits.join(neighbours(edges, most), "entity").select("query_id", F.col("beside").alias("entity"), "score")
    return best(hits.unionByName(beside).join(chunks_of, "entity").select("query_id", "chunk_id", "score"))


def packed(found: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """found (query_id, section, rank, text, tokens) as far as each section's budget of tokens goes, with the running sum in used.

    A section ends before the first row that doesn't fit, so what is left is its best; sections without a budget leave."""
    limit = F.coalesce(*(F.when(F.col("section") == k, F.lit(n)) for k, n in budgets.items()))
    used = F.sum("tokens").over(W.partitionBy("query_id", "section").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow))
    return found.withColumn("used", used).where(F.col("used") <= limit)


def context(kept: DataFrame, titles: dict[str, str]) -> DataFrame:
    """query_id, context: what packed() kept of a question as one text, sections in the order of titles; bounded by the budgets."""
    place = F.coalesce(*(F.when(F.col("section") == k, F.lit(i)) for i, k in enumerate(titles)))
    title = F.coalesce(*(F.when(F.col("section") == k, F.lit(t)) for k, t in titles.items()))
    sections = kept.groupBy("query_id", place.alias("place"), title.alias("title")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("body"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "title", "body"))), lambda x: F.concat(x["title"], F.lit("\n"), x["body"]))
    return sections.groupBy("query_id").agg(F.array_join(parts, "\n\n").alias("context"))


def global_(relation_hits: DataFrame, edges: DataFrame, chunks_of: DataFrame) -> DataFrame:
    """Relations (edge_id) by vector, then the entities at their ends, then those's chunks."""
    hits = relation_hits.select("query_id", F.col("vec_id").alias("edge_id"), "score").join(edges, "edge_id")
    ends = hits.select("query_id", F.explode(F.array("a", "b")).alias("entity"), "score")
    return best(ends.join(chunks_of, "entity").select("query_id", "chunk_id", "score"))


def best(found: DataFrame) -> DataFrame:
    """Each query's chunks once, with their highest score."""
    return found.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))


def both(*found: DataFrame) -> DataFrame:
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return best(out)


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def rerank(found: DataFrame, score: Column, k: int) -> DataFrame:
    """The k best by another score of columns of found."""
    return ranked(found.drop("rank").withColumn("score", score), k)


def reranked(found: DataFrame, questions: DataFrame, texts: DataFrame, load: Callable, k: int, of: int = 100) -> DataFrame:
    """query_id, chunk_id, score, rank: the k best of a question's first `of` chunks by a model over question and text.

    questions: query_id, question. texts: chunk_id, content. load: a model from pairs of both to scores. A pair that the
    model fails on, or without a text, has no score and comes last, in the old order."""
    first = found.where(F.col("rank") <= of) if "rank" in found.columns else ranked(found, of)
    met = first.join(questions.select("query_id", "question"), "query_id").join(texts.select("chunk_id", "content"), "chunk_id", "left")
    scored = met.select("query_id", "chunk_id", F.col("rank").alias("before"), models.pair_scores(F.col("question"), F.col("content"), load).alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "before", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("before")
