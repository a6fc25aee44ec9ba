"""Queries over ingest, files and questions from end to end, with deterministic stubs for models."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..config import Config
from ..functions import models
from ..operators import embedding, pipeline, queries, status
from ..shared import shared_folder
from ..sources import datasource, files
from . import stubs
from .common import BLOCKS, blocks, docs, prompt_sql, strip_sql, table, template_sql
from .context import FILLED, context_sql
from .ingest import HTML_SQL

FOLDERS = 1_024


def multimodal_pipeline(spark, sf_dir):
    """Ingest from end to end: all chunks."""
    return pipeline.ingest(docs(spark, sf_dir), models.stub_text, stubs.first_words).chunks


def multimodal_graph(spark, sf_dir):
    """The edges of the same."""
    return pipeline.ingest(docs(spark, sf_dir), models.stub_text, stubs.first_words).edges


def multimodal_nodes(spark, sf_dir):
    """The nodes of the same."""
    return pipeline.ingest(docs(spark, sf_dir), models.stub_text, stubs.first_words).nodes.select("entity_name", "entity_type", "n_mentions", "n_sources")


def split_ingest(spark, sf_dir):
    """Texts split at full stops, pieces of over 20 words in overlapping windows."""
    df = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text_content"))
    return pipeline.text_chunks(df, "doc_id", Config(chunk_size=20, chunk_overlap=5), split=".")


def document_states(spark, sf_dir):
    """States of documents of which some can't be read, some fail and some are still to be described."""
    parsed = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 3, "unreadable").alias("error"))
    made = blocks(spark, sf_dir).where("doc_id % 11 <> 5").select("doc_id", F.when((F.col("doc_id") % 5 == 1) | (F.col("pos") % 4 == 3), F.concat(F.lit("error "), F.col("pos") % 3)).alias("error"))
    return status.document_states(parsed, made, parsed.where("doc_id % 3 = 0"))


def dispatched_files(spark, sf_dir):
    """Pages as files of several kinds, each read by its parser or none."""
    ending = F.element_at(F.array(*map(F.lit, (".html", ".MD", ".pdf", ".htm"))), (F.col("page_id") % 4 + 1).cast("int"))
    given = table(spark, sf_dir, "pages").select(F.concat(F.lit("/in/"), "page_id", ending).alias("path"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("modificationTime"), F.coalesce("html", F.lit("")).cast("binary").alias("content"))
    got = files.dispatch(given, files.Registry(files.builtin_parsers()))
    said = F.array_join(F.transform("blocks", lambda b: b["text"]), "")
    return got.select("path", "parser", F.coalesce(F.size("blocks"), F.lit(0)).alias("n_blocks"), F.length(said).alias("n_chars"), "error")


def parser_source(spark, sf_dir):
    """Pages written as files and read by the library's data source, whose listing the filter on path reaches."""
    folder = f"{shared_folder(spark)}/pages-{uuid.uuid4()}"
    # directories of hashes, so that there are few and none is long
    at = F.format_string("%03x/page_id=%s.txt", F.pmod(F.xxhash64("page_id"), F.lit(FOLDERS)), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    files.written(table(spark, sf_dir, "pages").select(at.alias("path"), F.coalesce("html", F.lit("")).alias("content")), folder)
    rows = datasource.load(spark, folder, parser="html").where("path like '%.txt'")
    return rows.select(F.regexp_extract("path", "page_id=(-?[0-9]+)", 1).try_cast("long").alias("page_id"), "pos", "type", "text_level", "text")


def vision_answers(spark, sf_dir):
    """Questions put to a vision model with the safe ones of the images that their context names."""
    prompt = F.concat("text", F.lit("\nImage Path: /w/"), "conv_id", F.lit(".png\nmore\nImage Path: /etc/x.png"))
    q = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.col("text").alias("question"), prompt.alias("prompt"))
    return pipeline.answered_with_images(q, models.stub_vision, ["/w"])


def described_items(spark, sf_dir):
    """Questions with a table, a note and an image; a model describes the first two before the question is answered."""
    item = lambda kind, path=None, body=None, text=None: F.struct(F.lit(kind).alias("type"), F.lit(path).cast("string").alias("img_path"), (F.lit(None).cast("string") if body is None else body).alias("table_body"), (F.lit(None).cast("string") if text is None else text).alias("text"))
    items = F.array(item("table", body=F.col("text")), item("image", path="/a.png"), item("note", text=F.concat(F.lit("note "), F.col("text"))))
    q = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.col("text").alias("question"), items.alias("items"))
    return pipeline.answered_with_items(q, models.stub_text, describe=models.stub_text).select("query_id", "answer", "cached")


def tokens_within(spark, sf_dir):
    """Texts cut to 50 tokens of an encoder, and how many they had."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", models.within_tokens(text, 50, models.stub_offsets).alias("start"), models.token_counts(text, models.stub_encoder).alias("n"))


def offset_windows(spark, sf_dir):
    """Whole texts in windows of 50 tokens that share 10, cut at an encoder's offsets."""
    windows = models.token_windows(F.coalesce("text", F.lit("")), 50, 10, models.stub_offsets)
    df = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(windows)).alias("w")).select("doc_id", F.posexplode("w").alias("n", "w"))
    return df.select("doc_id", "n", "w.start", "w.tokens", "w.fresh", "w.content")


def embedded_chunks(spark, sf_dir):
    """Paragraphs with vectors that are kept by content: half of the texts first, then all, so the rest is embedded only."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text_content"))
    made = pipeline.text_chunks(docs.where("text_content <> ''"), "doc_id", Config(), split="\n", split_only=True)
    store = embedding.vector_store(spark, f"{shared_folder(spark)}/vectors-{uuid.uuid4()}")
    embedding.embedded(made.where("doc_id % 2 = 0"), store, models.stub_vectors(16), 16, "stub")
    rows = embedding.embedded(made, store, models.stub_vectors(16), 16, "stub")
    return rows.select("doc_id", "chunk_order_index", "hash", "model", "added", F.size("embedding").alias("dim"))


QUERIES = {f.__name__: f for f in (offset_windows, embedded_chunks, multimodal_pipeline, multimodal_graph, multimodal_nodes, split_ingest, document_states, dispatched_files, parser_source, vision_answers, described_items, tokens_within)}

_KINDS = ("image", "table", "equation")
_OF = {"table_body": "table_body", "text": "text", "text_format": "text_format", "context": "context"}
_ASKED = "case type " + " ".join(f"when '{k}' then case when context = '' then {prompt_sql(k, **_OF)} else {prompt_sql(k + '_with_context', **_OF)} end" for k in _KINDS) + " end"
_TOLD = "case type " + " ".join(f"when '{k}' then " + FILLED[k].replace("d' || pos", "about ' || h") for k in _KINDS) + " end"
_WORDS = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> ''))::int"
_CHUNKS = f"""{BLOCKS}, ctx as ({context_sql(1, 2000, "'text'", True)}),
m as (select b.*, c.context, case when b.caption = '' then 'None' else b.caption end as captions from blocks b join ctx c on b.doc_id = c.doc_id and b.pos = c.pos where b.type <> 'text'),
h as (select *, md5({_ASKED}) as h from m),
f as (select *, {_TOLD} as content from h),
modal as (select doc_id, 'chunk-' || md5(content) as chunk_id, max(pos) as pos, any_value(content) as content, any_value(type) as original_type, arg_max(h, pos) as h from f group by doc_id, content),
own as (select doc_id, {strip_sql('text')} as content, row_number() over (partition by doc_id order by pos) - 1 as i from blocks where type = 'text' and {strip_sql('text')} <> ''),
t as (select * from own union all select doc_id, {strip_sql('text')}, row_number() over (partition by doc_id order by pos) - 1 from blocks where type = 'equation' and {strip_sql('text')} <> '' and doc_id not in (select doc_id from own)),
base as (select doc_id, max(i) as base from t group by doc_id),
chunks as (
  select doc_id, 'chunk-' || md5(doc_id || ':' || i || ':' || content) as chunk_id, i::int as chunk_order_index, content, {_WORDS.format('content')} as tokens, null::varchar as original_type, null::varchar as modal_entity_name, null::varchar as error from t
  union all select m.doc_id, chunk_id, (coalesce(base, -1) + row_number() over (partition by m.doc_id order by pos))::int, content, {_WORDS.format('content')}, original_type, left(h, 6) || ' (thing)', null from modal m left join base on m.doc_id = base.doc_id),
found as (select chunk_id, unnest(list_distinct_ordered(w)) as entity_name from (select chunk_id, regexp_extract_all(content, '(?:^|[^\\p{{L}}])(\\p{{Lu}}\\p{{L}}{{3,}})', 1) as w from chunks))""".replace("list_distinct_ordered(w)", "list_filter(w, lambda x, i: list_position(w, x) = i)")
_GRAPH = """e as (select entity_name as src, modal_entity_name as tgt, f.chunk_id from found f join (select doc_id, chunk_id, modal_entity_name from chunks where modal_entity_name is not null) m on f.chunk_id = m.chunk_id where entity_name <> modal_entity_name)"""
_STUB = lambda x: f"""'```json' || chr(10) || '{{{{"detailed_description": "about ' || md5({x}) || '", "entity_info": {{{{"entity_name": "' || left(md5({x}), 6) || '", "entity_type": "thing", "summary": "' || substr(md5({x}), 7, 6) || '"}}}}}}}}' || chr(10) || '```'""".replace("{{", "{").replace("}}", "}")
_SUFFIX = template_sql(queries.SUFFIX, {})
_PIECES = rf"list_filter(list_transform(string_split(coalesce(text, ''), '.'), lambda x: {strip_sql('x')}), lambda x: x <> '')"
SQL = {
    "offset_windows": """with d as (select doc_id, coalesce(text, '') as t from documents), l as (select doc_id, t, length(regexp_extract(t, '^[ \\t\\r\\n]*')) as lead, regexp_extract_all(t, '[^ \\t\\r\\n]+[ \\t\\r\\n]*') as w from d),
        u as (select doc_id, unnest(range(0, len(w))) as i, unnest(w) as x, lead from l), s as (select doc_id, i, (lead + sum(length(x)) over (partition by doc_id order by i) - length(x))::int as at from u),
        k as (select doc_id, t, len(w) as c, unnest(range(0, greatest(1, ceil((len(w) - 10) / 40.0)::int))) as n from l),
        b as (select k.*, case when n = 0 then 0 else s1.at end as a, case when n * 40 + 50 >= c then length(t) else s2.at end as e from k left join s s1 on s1.doc_id = k.doc_id and s1.i = n * 40 left join s s2 on s2.doc_id = k.doc_id and s2.i = n * 40 + 50)
        select doc_id, n::int as n, a::int as start, (least(c, n * 40 + 50) - n * 40)::int as tokens, (coalesce(lag(e) over (partition by doc_id order by n), 0) - a)::int as fresh, substr(t, (a + 1)::bigint, (e - a)::bigint) as content from b""",
    "embedded_chunks": f"""with p as (select doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '') as l from documents), u as (select doc_id, unnest(range(0, len(l)))::int as chunk_order_index, md5(unnest(l)) as hash from p)
        select doc_id, chunk_order_index, hash, 'stub' as model, hash not in (select hash from u where doc_id % 2 = 0) as added, 16 as dim from u""",
    "multimodal_pipeline": f"with {_CHUNKS} select * from chunks",
    "multimodal_graph": f"with {_CHUNKS}, {_GRAPH} select least(src, tgt) as a, greatest(src, tgt) as b, sum(10.0::double) as weight, count(*) as n_edges, count(distinct chunk_id) as n_sources, 3 as n_keywords from e group by 1, 2",
    "multimodal_nodes": f"""with {_CHUNKS}, n as (select entity_name, 'word' as entity_type, chunk_id from found union all select left(h, 6) || ' (thing)', 'thing', chunk_id from modal), c as (select entity_name, entity_type, count(*) as n from n group by all)
        select entity_name, any_value(ty) as entity_type, count(*) as n_mentions, count(distinct chunk_id) as n_sources from n join (select entity_name, entity_type as ty from c qualify row_number() over (partition by entity_name order by n desc, entity_type) = 1) using (entity_name) group by entity_name""",
    "split_ingest": f"""with p as (select doc_id, {_PIECES} as l from documents), u as (select doc_id, unnest(range(0, len(l))) as a, unnest(l) as content from p), w as (select *, list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '') as w from u),
        x as (select doc_id, a, 0 as b, content from w where len(w) <= 20 union all select doc_id, a, k as b, array_to_string(w[k * 15 + 1 : k * 15 + 20], ' ') from (select *, unnest(range(0, ceil((len(w) - 20) / 15.0)::int + 1)) as k from w where len(w) > 20)),
        r as (select doc_id, content, (row_number() over (partition by doc_id order by a, b) - 1)::int as chunk_order_index from x)
        select doc_id, chunk_order_index, content, {_WORDS.format('content')} as tokens, 'chunk-' || md5(doc_id || ':' || chunk_order_index || ':' || content) as chunk_id from r""",
    "document_states": f"""with {BLOCKS}, p as (select doc_id, case when doc_id % 7 = 3 then 'unreadable' end as pe from documents), c as (select doc_id, count(*) as n, count(*) filter (doc_id % 5 = 1 or pos % 4 = 3) as bad, min(case when doc_id % 5 = 1 or pos % 4 = 3 then 'error ' || pos % 3 end) as why from blocks where doc_id % 11 <> 5 group by doc_id),
        s as (select p.doc_id, pe, why, coalesce(n, 0) as chunks_count, case when pe is not null or (bad > 0 and bad = n) then 'failed' when n is null then 'ready' when p.doc_id % 3 = 0 then 'handling' else 'processed' end as status from p left join c on p.doc_id = c.doc_id)
        select doc_id, status, coalesce(pe, why) as error, chunks_count, status = 'processed' as multimodal_processed from s""",
    "dispatched_files": rf"""with {HTML_SQL}, n as (select page_id, count(*) filter (text <> '') as n, coalesce(sum(length(text)) filter (text <> ''), 0) as c from t group by page_id),
        l as (select page_id, list_filter(list_transform(string_split(coalesce(html, ''), chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '') as l from pages)
        select '/in/' || page_id || ['.html', '.MD', '.pdf', '.htm'][(page_id % 4 + 1)::int] as path, case page_id % 4 when 1 then 'text' when 2 then 'pdf' else 'html' end as parser, case page_id % 4 when 1 then len(l) when 2 then 0 else n end::int as n_blocks,
          case page_id % 4 when 1 then length(array_to_string(list_transform(l, lambda x: {strip_sql("regexp_replace(x, '^#+', '')")}), '')) when 2 then null else c end::int as n_chars, case when page_id % 4 = 2 then 'no parser pdf' end as error from l join n using (page_id)""",
    "parser_source": f"with {HTML_SQL} select page_id, (row_number() over (partition by page_id order by k) - 1)::int as pos, 'text' as type, text_level, text from t where text <> ''",
    "vision_answers": f"""with q as (select conv_id || '-' || turn as query_id, text, text || chr(10) || 'Image Path: /w/' || conv_id || '.png' || chr(10) as p, {template_sql(queries.CLOSING.replace('{}', '{q}'), {'q': 'text'})} as c from conversations where role = 'user')
        select query_id, '1 of 1 images, ' || md5(p || chr(10) || chr(10) || 'more' || chr(10) || 'Image Path: /etc/x.png' || chr(10) || c) as answer, null::varchar as error, 1 as n_images from q""",
    "described_items": f"""with q as (select conv_id || '-' || turn as query_id, text, {template_sql(queries.ITEM_PROMPTS['table'], {'table_body': 'text'})} as a, {template_sql(queries.ITEM_PROMPTS['generic'], {'type': "'note'", 'content': "'note ' || text"})} as b from conversations where role = 'user'),
        e as (select query_id, 'User query: ' || text || chr(10) || chr(10) || 'Related table content: ' || {_STUB('a')} || chr(10) || chr(10) || 'Related image content: Image path: /a.png' || chr(10) || chr(10) || 'Related note content: ' || {_STUB('b')} || {_SUFFIX} as x from q)
        select query_id, {_STUB('x')} as answer, false as cached from e""",
    "tokens_within": rf"""with d as (select doc_id, coalesce(text, '') as x, {_WORDS.format("coalesce(text, '')")} as n from documents) select doc_id, case when n <= 50 then x else regexp_extract(x, '^\s*(?:\S+\s+){{50}}') || '...' end as start, n from d""",
}
