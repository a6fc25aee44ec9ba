"""The property graph: entities, edges, their merge over chunks, routing of blocks to processors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import hash_id

#: What each kind of processor can do.
SUPPORTS = {
    "image": ["Image content analysis", "Visual understanding", "Image description generation", "Image entity extraction"],
    "table": ["Table structure analysis", "Data statistics", "Trend identification", "Table entity extraction"],
    "equation": ["Mathematical formula parsing", "Variable identification", "Formula meaning explanation", "Formula entity extraction"],
    "generic": ["General content analysis", "Structured processing", "Entity extraction"],
}
BASIC = ["Basic processing"]


def supports(type_: str = "type"):
    out = F.lit(None)
    for kind, items in SUPPORTS.items():
        out = F.when(F.col(type_) == kind, F.array(*map(F.lit, items))).otherwise(out)
    return F.coalesce(out, F.array(*map(F.lit, BASIC)))


def processors(spark: SparkSession, enabled: tuple[str, ...]) -> DataFrame:
    """type, processor, enabled: as many rows as there are built-in kinds."""
    return spark.createDataFrame([(k, f"{k}_processor", k in enabled) for k in SUPPORTS], "type string, processor string, enabled boolean")


def route(blocks: DataFrame, dim: DataFrame) -> DataFrame:
    """blocks with their processor: of their type, the generic one for types without one; a type that is switched off has none and leaves."""
    dim = F.broadcast(dim.withColumnRenamed("type", "_t"))  # one row for each kind
    met = blocks.join(dim, F.col("type") == F.col("_t"), "left")
    other = F.col("_t").isNull()
    return met.where(other | F.col("enabled")).withColumn("processor", F.when(other, "generic_processor").otherwise(F.col("processor"))).drop("_t", "enabled")


def entity_rows(chunks: DataFrame) -> DataFrame:
    """Graph nodes with their vector-store ids, from chunks (chunk_id, file_path) with an entity struct."""
    e = F.col("entity")
    return chunks.select(
        hash_id(e["entity_name"], "ent-").alias("entity_id"), e["entity_name"].alias("entity_name"), e["entity_type"].alias("entity_type"), e["summary"].alias("description"),
        F.concat(e["entity_name"], F.lit("\n"), e["summary"]).alias("content"), F.col("chunk_id").alias("source_id"), "file_path",
    )


def belongs_to(found: DataFrame, modal: DataFrame) -> DataFrame:
    """Edges from each entity found in a chunk (chunk_id, entity_name) to the entity that the chunk is about (chunk_id, modal_entity_name); none to itself.

    What chunks are about, a row each, is hashed, so that a task sorts neither side."""
    met = found.join(modal.hint("shuffle_hash"), "chunk_id").where(F.col("entity_name") != F.col("modal_entity_name"))
    src, tgt = F.col("entity_name"), F.col("modal_entity_name")
    words = F.lit("belongs_to,part_of,contained_in")
    described = F.concat(F.lit("Entity "), src, F.lit(" belongs to "), tgt)
    return met.select(
        hash_id(F.concat(src, tgt), "rel-").alias("relation_id"), src.alias("src_id"), tgt.alias("tgt_id"), described.alias("description"), words.alias("keywords"),
        F.concat_ws("\t", words, src, tgt, described).alias("content"), F.col("chunk_id").alias("source_id"), F.lit(10.0).alias("weight"),
    )


def merge_names(old, new):
    """Names in order, each once, old ones first."""
    return F.array_distinct(F.concat(F.coalesce(old, F.expr("cast(array() as array<string>)")), F.coalesce(new, F.expr("cast(array() as array<string>)"))))


def merge_full_entities(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """full_entities with new names appended; other columns of old stay. update_time comes from new rows."""
    new = new.select(key, F.col("entity_names").alias("_new"), F.col("update_time").alias("_time"))
    met = old.join(new, key, "full_outer").withColumn("entity_names", merge_names(F.col("entity_names"), F.col("_new")))
    return met.withColumn("count", F.size("entity_names")).withColumn("update_time", F.coalesce("_time", "update_time")).drop("_new", "_time")


def listed(rows: DataFrame, keys: list[str], *fields: str) -> DataFrame:
    """keys, field, value: every value of some fields of rows with these keys once, whatever their number; no nulls, no empty ones."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))
    return rows.select(*keys, F.inline(pairs)).where("value is not null and value <> ''").distinct()


def node_values(nodes: DataFrame) -> DataFrame:
    """entity_name, field (description or source_id), value: all that was said of each name."""
    return listed(nodes, ["entity_name"], "description", "source_id")


def edge_values(edges: DataFrame) -> DataFrame:
    """a, b, field (description, keyword or source_id), value: all that was said of each pair of names; keywords apart.

    Each field is made distinct in tasks of its own, and lists of keywords before they are taken apart, so that a task holds one field's values."""
    pair = edges.withColumns({"a": F.least("src_id", "tgt_id"), "b": F.greatest("src_id", "tgt_id")})
    pair = pair if "description" in pair.columns else pair.withColumn("description", F.lit(None).cast("string"))
    lists = pair.select("a", "b", F.coalesce("keywords", F.lit("")).alias("keywords")).distinct()
    words = lists.select("a", "b", F.explode(F.split("keywords", ",")).alias("keyword"))
    return listed(pair, ["a", "b"], "description").unionByName(listed(pair, ["a", "b"], "source_id")).unionByName(listed(words, ["a", "b"], "keyword"))


def _counts(values: DataFrame, keys: list[str], names: dict[str, str]) -> DataFrame:
    return values.groupBy(*keys).agg(*(F.count_if(F.col("field") == f).alias(n) for f, n in names.items()))


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One node for each name: its most frequent type (ties: first by name), how many mentions, sources and different
    descriptions it has. The descriptions themselves are rows (node_values), or one text by reduction.reduced()."""
    each = nodes.groupBy("entity_name", "entity_type").agg(F.count("*").alias("n"))
    merged = each.groupBy("entity_name").agg(F.min_by("entity_type", F.struct(-F.col("n"), "entity_type")).alias("entity_type"), F.sum("n").alias("n_mentions"))
    counts = _counts(node_values(nodes), ["entity_name"], {"source_id": "n_sources", "description": "n_descriptions"})
    out = merged.join(counts, "entity_name", "left")
    return out.select("entity_name", "entity_type", "n_mentions", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_sources", "n_descriptions")))


def merge_edges(edges: DataFrame) -> DataFrame:
    """One undirected edge for each pair of names: summed weight, how many edges, sources and different keywords; these are rows of edge_values()."""
    pair = edges.withColumns({"a": F.least("src_id", "tgt_id"), "b": F.greatest("src_id", "tgt_id")})
    merged = pair.groupBy("a", "b").agg(F.sum("weight").alias("weight"), F.count("*").alias("n_edges"))
    counts = _counts(edge_values(edges), ["a", "b"], {"source_id": "n_sources", "keyword": "n_keywords"})
    return merged.join(counts, ["a", "b"], "left").select("a", "b", "weight", "n_edges", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_sources", "n_keywords")))
