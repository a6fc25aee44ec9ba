"""Queries over context and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as X
from ..operators import chunks as C
from ..operators import context as O
from .common import BLOCKS, blocks, docs, hash_sql, strip_sql, table, truncate_sql

KEPT = ("doc_id", "pos", "type", "page_idx", "context")


def page_context(spark, sf_dir):
    return O.page_context(blocks(spark, sf_dir)).select(*KEPT)


def page_context_in_rows(spark, sf_dir):
    """The same within each document's row: more work for the processors, no shuffle."""
    return O.document_context(docs(spark, sf_dir)).select(*KEPT)


def page_context_wide(spark, sf_dir):
    """Captions count as well, and the limit is short."""
    return O.page_context(blocks(spark, sf_dir), Config(context_window=2, max_context_tokens=300, context_filter_types=("text", "image", "table"))).select(*KEPT)


def chunk_context(spark, sf_dir):
    return O.chunk_context(blocks(spark, sf_dir), Config(context_window=2)).select(*KEPT)


def chunk_context_in_rows(spark, sf_dir):
    return O.document_context(docs(spark, sf_dir), Config(context_mode="chunk", context_window=2)).select(*KEPT)


def context_text(spark, sf_dir):
    return blocks(spark, sf_dir).select("doc_id", "pos", O.item_text().alias("said"))


def truncate_context(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", *(X.truncate(text, n).alias(f"c{n}") for n in (2000, 300, 50)))


def text_chunk_context(spark, sf_dir):
    """The context of every line within its document's array of lines."""
    said = docs(spark, sf_dir).select("doc_id", F.transform("blocks", lambda b: F.coalesce(b["text"], b["table_body"], F.lit(""))).alias("said"))
    each = F.transform(F.sequence(F.lit(0), F.size("said") - 1), lambda i: F.struct(i.alias("pos"), O.texts_context("said", i, Config(context_window=2)).alias("context")))
    return said.select("doc_id", F.inline(each))


def map_context(spark, sf_dir):
    first = lambda k: F.when(F.col("doc_id") % 3 == k, F.col("text"))
    m = F.map_filter(F.create_map(F.lit("content"), first(0), F.lit("text"), first(1), F.lit("other"), first(2), F.lit("lang"), F.col("lang")), lambda k, v: v.isNotNull())
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", O.map_context(m).alias("context"))


def embedding_only_chunks(spark, sf_dir):
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n"))
    return C.paragraph_chunks(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")), "doc_id", "text")


def _described(spark, sf_dir):
    return blocks(spark, sf_dir).where("type <> 'text'").withColumns({"footnotes": F.lit(None).cast("array<string>"), "extra": F.lit(None).cast("string"), "description": F.concat(F.lit("d"), F.col("pos").cast("string"))})


def _template(kind):
    def query(spark, sf_dir):
        df = _described(spark, sf_dir).where(F.col("type") == kind) if kind in C.TEMPLATES and kind != "generic" else _described(spark, sf_dir).where("type = 'equation'").withColumn("type", F.lit("custom_type"))
        return df.select("doc_id", "pos", C.templated(kind, F.col("description")).alias("content"))

    return query


def multimodal_chunks(spark, sf_dir):
    df = _described(spark, sf_dir).withColumn("content", C.modal_chunk(F.col("description")))
    return df.select("doc_id", "pos", X.hash_id("content", "chunk-").alias("chunk_id"), X.tokens("content").alias("tokens"), F.col("type").alias("original_type"))


def dedupe_chunks(spark, sf_dir):
    """Equal contents of a document are one chunk, of the last place."""
    from ..operators.status import latest

    df = blocks(spark, sf_dir).select("doc_id", "pos", X.hash_id(F.coalesce("text", "table_body", "img_path"), "chunk-").alias("chunk_id"), F.col("type"))
    return latest(df, ["doc_id", "chunk_id"], "pos").select("doc_id", "chunk_id", "pos", "type")


def split_by_character(spark, sf_dir):
    return C.split_chunks(table(spark, sf_dir, "documents").where("text is not null"), "doc_id", "text", ".")


def token_window_chunks(spark, sf_dir):
    return C.window_chunks(table(spark, sf_dir, "documents").where("text is not null"), "doc_id", "text", 120, 20)


def chunk_order(spark, sf_dir):
    """Chunks of other blocks are numbered on from the text's."""
    base = F.size(F.filter("blocks", lambda b: b["type"] == "text"))
    items = F.filter("blocks", lambda b: b["type"] != "text")
    df = docs(spark, sf_dir).select("doc_id", base.alias("base"), F.size(items).alias("n"), F.posexplode(items).alias("i", "b"))
    return df.select("doc_id", F.col("b.pos").alias("pos"), (F.col("base") + F.col("i")).alias("chunk_order_index"), C.progress(F.col("i") + 1, F.col("n")).alias("report"))


QUERIES = {f.__name__: f for f in (page_context, page_context_in_rows, page_context_wide, chunk_context, chunk_context_in_rows, context_text, truncate_context, text_chunk_context, map_context, embedding_only_chunks, multimodal_chunks, dedupe_chunks, split_by_character, token_window_chunks, chunk_order)}
QUERIES |= {f"chunk_template_{k}": _template(k) for k in C.TEMPLATES}

_SAID = "case when type = 'text' then case when text_level > 0 then repeat('#', text_level) || ' ' || text else text end when type = 'image' then '[Image: ' || caption || ']' when type = 'table' then '[Table: ' || caption || ']' else '' end"


def context_sql(window: int, limit: int, types: str, page: bool) -> str:
    near = f"n.page_idx between b.page_idx - {window} and b.page_idx + {window}" if page else f"n.pos between b.pos - {window} and b.pos + {window} and n.pos <> b.pos"
    said = "case when n.page_idx <> b.page_idx then '[Page ' || n.page_idx || '] ' || n.said else n.said end" if page else "n.said"
    return f"""with {BLOCKS}, said as (select *, {_SAID} as said from blocks),
      c as (select b.doc_id, b.pos, b.type, b.page_idx, coalesce(string_agg({said}, chr(10) order by n.pos), '') as x from said b left join said n on b.doc_id = n.doc_id and {near} and n.type in ({types}) and {strip_sql('n.said')} <> '' where b.type <> 'text' group by all)
      select doc_id, pos, type, page_idx, {truncate_sql('x', limit)} as context from c"""


FILLED = {
    "image": "chr(10) || 'Image Content Analysis:' || chr(10) || 'Image Path: ' || img_path || chr(10) || 'Captions: ' || case when caption = '' then 'None' else caption end || chr(10) || 'Footnotes: None' || chr(10) || chr(10) || 'Visual Analysis: d' || pos",
    "table": "'Table Analysis:' || chr(10) || 'Image Path: ' || chr(10) || 'Caption: ' || case when caption = '' then 'None' else caption end || chr(10) || 'Structure: ' || table_body || chr(10) || 'Footnotes: None' || chr(10) || chr(10) || 'Analysis: d' || pos",
    "equation": "'Mathematical Equation Analysis:' || chr(10) || 'Equation: ' || text || chr(10) || 'Format: latex' || chr(10) || chr(10) || 'Mathematical Analysis: d' || pos",
    "generic": "'Custom_Type Content Analysis:' || chr(10) || 'Content: ' || text || chr(10) || chr(10) || 'Analysis: d' || pos",
}
_WORDS = "list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> '')"
SQL = {
    "page_context": context_sql(1, 2000, "'text'", True),
    "page_context_wide": context_sql(2, 300, "'text', 'image', 'table'", True),
    "chunk_context": context_sql(2, 2000, "'text'", False),
    "page_context_in_rows": context_sql(1, 2000, "'text'", True),
    "chunk_context_in_rows": context_sql(2, 2000, "'text'", False),
    "context_text": f"with {BLOCKS} select doc_id, pos, {_SAID} as said from blocks",
    "truncate_context": f"with d as (select doc_id, coalesce(text, '') as x from documents) select doc_id, {', '.join(f'{truncate_sql("x", n)} as c{n}' for n in (2000, 300, 50))} from d",
    "text_chunk_context": f"""with {BLOCKS}, t as (select doc_id, pos, {strip_sql("coalesce(text, table_body, '')")} as x from blocks), c as (select t.doc_id, t.pos, coalesce(string_agg(n.x, chr(10) order by n.pos), '') as x from t left join t n on n.doc_id = t.doc_id and n.pos between t.pos - 2 and t.pos + 2 and n.pos <> t.pos and n.x <> '' group by t.doc_id, t.pos)
        select doc_id, pos, {truncate_sql('x', 2000)} as context from c""",
    "map_context": f"with d as (select doc_id, case when doc_id % 3 = 2 then lang || chr(10) || text else text end as x from documents where text is not null) select doc_id, {truncate_sql('x', 2000)} as context from d",
    "embedding_only_chunks": f"""with p as (select doc_id, coalesce(text, '') as t, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '') as l from documents), c as (select doc_id, case when len(l) > 0 then l else [t] end as l from p),
        e as (select doc_id, unnest(range(0, len(l)))::int as chunk_order_index, unnest(l) as content from c) select doc_id, chunk_order_index, content, len({_WORDS.format('content')})::int as tokens, {hash_sql("doc_id || ':' || chunk_order_index || ':' || content", 'chunk-')} as chunk_id from e""",
    **{f"chunk_template_{k}": f"with {BLOCKS} select doc_id, pos, {v} as content from blocks where type = '{'equation' if k == 'generic' else k}'" for k, v in FILLED.items()},
    "multimodal_chunks": f"with {BLOCKS}, c as (select doc_id, pos, type, case type when 'image' then {FILLED['image']} when 'table' then {FILLED['table']} else {FILLED['equation']} end as content from blocks where type <> 'text') select doc_id, pos, 'chunk-' || md5(content) as chunk_id, len({_WORDS.format('content')})::int as tokens, type as original_type from c",
    "dedupe_chunks": f"with {BLOCKS} select doc_id, 'chunk-' || md5(coalesce(text, table_body, img_path)) as chunk_id, max(pos) as pos, arg_max(type, pos) as type from blocks group by 1, 2",
    "split_by_character": f"with p as (select doc_id, list_filter(list_transform(string_split(text, '.'), lambda x: {strip_sql('x')}), lambda x: x <> '') as l from documents where text is not null) select doc_id, unnest(range(0, len(l)))::int as chunk_order_index, unnest(l) as content from p",
    "token_window_chunks": f"""with w as (select doc_id, {_WORDS.format('text')} as w from documents where text is not null), k as (select doc_id, w, unnest(range(0, ceil(greatest(len(w) - 120, 0) / 100.0)::int + 1))::int as chunk_order_index from w where len(w) > 0)
        select doc_id, chunk_order_index, array_to_string(w[chunk_order_index * 100 + 1 : chunk_order_index * 100 + 120], ' ') as content, len(w[chunk_order_index * 100 + 1 : chunk_order_index * 100 + 120])::int as tokens from k""",
    "chunk_order": f"""with {BLOCKS}, n as (select *, count(*) filter (type = 'text') over (partition by doc_id) as base, count(*) filter (type <> 'text') over (partition by doc_id) as n from blocks), r as (select *, row_number() over (partition by doc_id order by pos) as i from n where type <> 'text')
        select doc_id, pos, (base + i - 1)::int as chunk_order_index, i % greatest(1, n // 10) = 0 as report from r""",
}
