"""Ingest and questions from end to end. Questions are lazy plans; ingest writes what models say when it is called, and its relations read that."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import HTML, Config
from ..functions import models, repair
from ..functions.prompts import Prompts
from ..functions.text import hash_id, image_data, tokens
from ..shared import durable
from ..sources import files
from . import blocks as B
from . import chunks, context, extraction, graph, queries, reduction, retrieval, status
from .callbacks import Callbacks


@dataclass(frozen=True)
class Ingested:
    """What ingest gives. values: all that was said of each node (graph.node_values); nodes have one description of it if ingest
    was given a model that sums up. relations: the typed ones of the extractor, with ids and texts for a vector store."""

    documents: DataFrame
    chunks: DataFrame
    nodes: DataFrame
    edges: DataFrame
    full_entities: DataFrame
    doc_status: DataFrame
    values: DataFrame
    relations: DataFrame


@dataclass(frozen=True)
class Modality:
    """A processor for a type of one's own: its prompt from the blocks' columns and context, and its chunk from a description."""

    type: str
    prompt: Callable[[Column], Column]
    chunk: Callable[[Column], Column] | None = None


def described(blocks: DataFrame, load: Callable, config: Config = Config(), prompts: Prompts = Prompts(), key: str = "doc_id", own: tuple[Modality, ...] = ()) -> DataFrame:
    """Blocks other than text with context, the model's entity, and error. A failed call leaves its row with the fallback of an empty answer and its error."""
    near = context.page_context if config.context_mode == "page" else context.chunk_context
    df = near(blocks, config, key)
    df = graph.route(df, graph.processors(df.sparkSession, config.enabled_types()))
    prompt = prompts.for_blocks(F.col("context"))
    for m in own:
        prompt = F.when(F.col("type") == m.type, m.prompt(F.col("context"))).otherwise(prompt)
        df = df.withColumn("processor", F.when(F.col("type") == m.type, f"{m.type}_processor").otherwise(F.col("processor")))
    df = df.withColumn("_a", models.answers(prompt, load))
    return df.withColumn("entity", repair.entities(F.coalesce("_a.value", F.lit("")), F.col("type"))).withColumn("error", F.col("_a.error")).drop("_a")


def modal_chunks(items: DataFrame, key: str = "doc_id", own: tuple[Modality, ...] = ()) -> DataFrame:
    """Chunks of described blocks, the template filled once for all that need it; blocks of equal content in a document are one chunk."""
    content = chunks.modal_chunk(F.col("entity.description"))
    for m in own:
        content = F.when(F.col("type") == m.type, m.chunk(F.col("entity.description"))).otherwise(content) if m.chunk else content
    df = items.withColumn("content", content)
    df = df.select(key, "pos", "page_idx", F.col("type").alias("original_type"), "content", hash_id("content", "chunk-").alias("chunk_id"), tokens("content").alias("tokens"), F.col("entity.entity_name").alias("modal_entity_name"), "entity", "error")
    return status.latest(df, [key, "chunk_id"], "pos")


def text_chunks(docs: DataFrame, key: str, config: Config, split: str | None = None, split_only: bool = False, by_tokens: bool = False, encoder: Callable | None = None) -> DataFrame:
    """key, chunk_order_index, content, tokens, chunk_id of text_content: its paragraphs; or what stands between split, and
    unless split_only any such piece of over chunk_size words in overlapping windows; or by_tokens such windows of the whole text. encoder: offsets of tokens (models.OffsetEncoder),
    by which windows are cut in place of words."""
    if encoder is not None and (by_tokens or (split is not None and not split_only)):
        whole = docs.select(key, F.lit(0).alias("_a"), F.col("text_content").alias("content")) if split is None else chunks.split_chunks(docs, key, "text_content", split).select(key, F.col("chunk_order_index").alias("_a"), "content")
        cut = models.token_windows(F.col("content"), config.chunk_size, config.chunk_overlap, encoder)
        pieces = whole.select(key, "_a", F.explode(F.array(cut)).alias("_w")).select(key, "_a", F.posexplode("_w").alias("_b", "w"))
        order = (F.row_number().over(W.partitionBy(key).orderBy("_a", "_b")) - 1).alias("chunk_order_index")
        return chunks.with_chunk_id(pieces.select(key, order, F.col("w.content").alias("content"), F.col("w.tokens").alias("tokens")), key)
    if split is None and not by_tokens:
        return chunks.paragraph_chunks(docs, key, "text_content")
    if split is None:
        return chunks.with_chunk_id(chunks.window_chunks(docs, key, "text_content", config.chunk_size, config.chunk_overlap), key)
    pieces = chunks.split_chunks(docs, key, "text_content", split).withColumn("tokens", tokens("content"))
    if not split_only:
        long = chunks.windows(F.col("content"), config.chunk_size, config.chunk_overlap)
        parts = F.when(F.col("tokens") <= config.chunk_size, F.array("content")).otherwise(long)
        pieces = pieces.select(key, F.col("chunk_order_index").alias("_a"), F.posexplode(parts).alias("_b", "content"))
        pieces = pieces.select(key, (F.row_number().over(W.partitionBy(key).orderBy("_a", "_b")) - 1).alias("chunk_order_index"), "content", tokens("content").alias("tokens"))
    return chunks.with_chunk_id(pieces.select(key, "chunk_order_index", "content", "tokens"), key)


def _found(got: DataFrame | extraction.Extraction) -> tuple[DataFrame, DataFrame]:
    """Entities and relations, written once."""
    if isinstance(got, extraction.Extraction):
        return durable(extraction.with_ends(got)), durable(got.relations)
    none = got.sparkSession.createDataFrame([], "chunk_id string, src_id string, tgt_id string, description string, keywords string, weight double, source_id string")
    return durable(got), none


def ingest(
    docs: DataFrame, load: Callable, extract: Callable[[DataFrame], DataFrame | extraction.Extraction], config: Config = Config(), prompts: Prompts = Prompts(), key: str = "doc_id", done: DataFrame | None = None, skip_multimodal: bool = False,
    split: str | None = None, split_only: bool = False, by_tokens: bool = False, encoder: Callable | None = None, own: tuple[Modality, ...] = (), callbacks: Callbacks | None = None, summarise: Callable | None = None,
) -> Ingested:
    """docs: key and blocks. load: the model. extract: entities (chunk_id, entity_name, entity_type, description, source_id) of chunks (chunk_id, content), or entities and relations (extraction.extractor). summarise: a model for the nodes' descriptions. done: doc_status of earlier runs, whose finished documents aren't described again. split, split_only, by_tokens, encoder: see text_chunks(). own: processors of further types.

    What the models say, of blocks and of chunks, is written to the shared folder once, and all relations read that:
    each block is described by one call, and answers that vary can't make relations disagree."""
    separated = B.recovered(docs)
    text = text_chunks(separated.where("text_content <> ''"), key, config, split, split_only, by_tokens, encoder)
    text = text.select(key, "chunk_id", "chunk_order_index", "content", "tokens", F.lit(None).cast("string").alias("original_type"), F.lit(None).cast("string").alias("modal_entity_name"), F.lit(None).cast("string").alias("error"))
    todo = docs if done is None else status.gate(docs, done, key)
    blocks = todo.select(key, F.inline("blocks"))
    for c, kind in (("footnotes", "array<string>"), ("extra", "string"), ("text_format", "string")):
        if c not in blocks.columns:
            blocks = blocks.withColumn(c, F.lit(None).cast(kind))
    modal = modal_chunks(described(blocks, load, config, prompts, key, own), key, own)
    told = callbacks or Callbacks()
    modal = modal.where(F.lit(False)) if skip_multimodal else told.timed("multimodal", lambda: durable(modal), stage="multimodal")
    # other blocks' chunks are numbered on from the text's
    base = text.groupBy(key).agg(F.max("chunk_order_index").alias("_base"))
    numbered = modal.join(base, key, "left").withColumn("chunk_order_index", (F.coalesce("_base", F.lit(-1)) + F.row_number().over(W.partitionBy(key).orderBy("pos"))).cast("int"))
    both = text.unionByName(numbered.select(*text.columns))
    found, relations = told.timed("text_insert", lambda: _found(extract(both.select("chunk_id", "content"))), stage="extract")
    mine = modal.select(F.col("modal_entity_name").alias("entity_name"), F.col("entity.entity_type").alias("entity_type"), F.col("entity.summary").alias("description"), F.col("chunk_id").alias("source_id"))
    said = found.select("entity_name", "entity_type", "description", "source_id").unionByName(mine)
    nodes = graph.merge_nodes(said)
    if summarise is not None:
        nodes = nodes.join(reduction.reduced(said, ["entity_name"], summarise).select("entity_name", "description"), "entity_name", "left")
    beside = graph.belongs_to(found, modal.select("chunk_id", "modal_entity_name")).select("src_id", "tgt_id", "description", "keywords", "weight", "source_id")
    edges = graph.merge_edges(beside.unionByName(relations.select(*beside.columns)))
    names = modal.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "modal_entity_name"))), lambda x: x["modal_entity_name"]).alias("entity_names"))
    names = names.withColumn("entity_names", F.array_distinct("entity_names")).withColumn("count", F.size("entity_names"))
    state = status.document_status(both, key).withColumn("multimodal_processed", F.lit(not skip_multimodal))
    return Ingested(separated.select(key, B.content_id("blocks").alias("content_id"), "text_content"), both, nodes, edges, names, state, graph.node_values(said), extraction.relation_rows(relations))


def ingest_folder(spark: SparkSession, folder: str, registry: files.Registry, load: Callable, extract: Callable[[DataFrame], DataFrame], config: Config = Config(), cache: DataFrame | None = None, dry_run: bool = False, callbacks: Callbacks | None = None, **options) -> tuple[DataFrame, Ingested | None]:
    """(the folder's files with parser, blocks, error; what ingest() gives of those that could be parsed). With dry_run only
    the list of files and parsers, of which no byte is read."""
    if dry_run:
        listed = files.listing(spark, folder, config.supported_extensions + HTML, config.recursive)
        return listed.withColumn("parser", files.route("path")), None
    told = callbacks or Callbacks()
    found = files.scan_folder(spark, folder, config.supported_extensions + HTML, config.recursive)
    told.dispatch("batch_start", file_path=folder)
    parsed = told.timed("parse", lambda: durable(files.dispatch(found, registry, cache=cache, method=config.parse_method)), file_path=folder, stage="parse")
    docs = parsed.where("error is null").select(F.col("path").alias("doc_id"), "blocks")
    out = ingest(docs, load, extract, config, callbacks=told, **options)
    told.dispatch("batch_complete", file_path=folder, files=parsed.count(), failed=parsed.where("error is not null").count())
    return parsed, out


def retrieve(mode: str, question_vectors: DataFrame, chunk_vectors: DataFrame, entity_vectors: DataFrame, relation_vectors: DataFrame, edges: DataFrame, chunks_of: DataFrame, config: Config = Config()) -> DataFrame:
    """query_id, chunk_id, score, rank in one of retrieval.MODES. Vectors: vec_id, embedding."""
    if mode not in retrieval.MODES:
        raise ValueError(f"no mode {mode}; there are {', '.join(retrieval.MODES)}")
    hits = lambda v: retrieval.top_k(question_vectors, v, config.top_k, config.cosine_threshold, self_match=True)
    parts = []
    if mode in ("naive", "mix"):
        parts.append(retrieval.naive(hits(chunk_vectors)))
    if mode in ("local", "hybrid", "mix"):
        parts.append(retrieval.local(hits(entity_vectors), edges, chunks_of))
    if mode in ("global", "hybrid", "mix"):
        parts.append(retrieval.global_(hits(relation_vectors), edges, chunks_of))
    if not parts:
        return question_vectors.sparkSession.createDataFrame([], "query_id long, chunk_id long, score double, rank int")
    return retrieval.ranked(retrieval.both(*parts), config.top_k)


def answered(questions: DataFrame, found: DataFrame, texts: DataFrame, load: Callable, system: Column | None = None) -> DataFrame:
    """query_id, answer, error: each question (query_id, question) put to the model with its chunks (chunk_id, content), best first. At most the top_k chunks of a question meet."""
    near = found.join(texts, "chunk_id").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]), "\n\n").alias("_c"))
    df = questions.join(near, "query_id", "left")
    prompt = F.concat(F.lit("") if system is None else system, F.lit("Context:\n"), F.coalesce("_c", F.lit("")), F.lit("\n\nUser Question: "), F.col("question"))
    return df.select("query_id", models.answers(prompt, load).alias("a")).select("query_id", F.col("a.value").alias("answer"), "a.error")


def answered_with_items(questions: DataFrame, load: Callable, cache: DataFrame | None = None, mode: str = "mix", describe: Callable | None = None) -> DataFrame:
    """query_id, cache_key, answer, cached of questions (query_id, question, items of type, img_path, table_body, text): from the cache (cache_key, answer), else from the model by the enhanced question. describe: a model that describes tables, equations and other items first; without it their own text stands for them."""
    df = questions.withColumn("cache_key", queries.cache_key(F.col("question"), F.col("items"), F.lit(mode)))
    if cache is None:
        df = df.withColumn("_hit", F.lit(None).cast("string"))
    else:
        df = df.join(cache.select("cache_key", F.col("answer").alias("_hit")).dropDuplicates(["cache_key"]), "cache_key", "left")
    none = F.lit(None).cast("array<string>")
    plain = lambda i: F.coalesce(i["text"], i["table_body"], queries.described_image(i["img_path"], none, none))
    told = F.transform("items", lambda i: F.struct(i["type"].alias("type"), plain(i).alias("description")))
    if describe is not None:
        # each item is a row of the model's; a question's few items come together again
        each = df.where("_hit is null").select("query_id", F.posexplode("items").alias("_k", "_i"))
        each = each.withColumn("_d", models.answers(queries.item_prompt(F.col("_i")), describe)["value"])
        each = each.select("query_id", F.struct("_k", F.col("_i.type").alias("type"), F.coalesce("_d", plain(F.col("_i"))).alias("description")).alias("_s"))
        df = df.join(each.groupBy("query_id").agg(F.array_sort(F.collect_list("_s")).alias("_told")), "query_id", "left")
        told = F.transform(F.coalesce("_told", F.expr("cast(array() as array<struct<_k:int,type:string,description:string>>)")), lambda i: F.struct(i["type"].alias("type"), i["description"].alias("description")))
    prompt = F.when(F.col("_hit").isNull(), queries.enhanced(F.col("question"), told))
    return df.select("query_id", "cache_key", F.coalesce("_hit", models.answers(prompt, load)["value"]).alias("answer"), F.col("_hit").isNotNull().alias("cached"))


def answered_with_images(questions: DataFrame, load: Callable, folders: list[str], images: DataFrame | None = None, system: Column | None = None) -> DataFrame:
    """query_id, answer, error, n_images: each question (query_id, question, prompt: its retrieved context) put to a vision
    model with the images that its prompt names and that lie in one of folders. images: files (path, content) whose bytes
    the model gets as base64; those that aren't there, and all without images, are given by path."""
    m = queries.vision_messages(questions, "prompt", "question", folders, system)
    if images is not None:
        each = m.select("query_id", F.posexplode("images").alias("_k", "path")).join(images.select("path", image_data("content").alias("_b")), "path", "left")
        held = each.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", F.coalesce("_b", "path").alias("b")))), lambda x: x["b"]).alias("_held"))
        m = m.join(held, "query_id", "left").withColumn("images", F.coalesce("_held", "images"))
    m = m.withColumn("_a", F.explode(F.array(models.seen(F.col("system"), F.col("parts"), F.col("images"), load))))
    return m.select("query_id", F.col("_a.value").alias("answer"), F.col("_a.error").alias("error"), F.size("images").alias("n_images"))
