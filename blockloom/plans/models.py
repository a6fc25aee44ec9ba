"""Queries over models' answers, the graph and multimodal questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Config
from ..functions import repair as R
from ..functions import text as X
from ..operators import graph as G
from ..operators import queries as Q
from .common import ANSWERS, BLOCKS, answers, blocks, prompt_sql, strip_sql, table


def _answers(spark, sf_dir):
    return answers(blocks(spark, sf_dir))


def strip_thinking(spark, sf_dir):
    return _answers(spark, sf_dir).select("doc_id", "pos", X.strip_thinking("answer").alias("cleaned"))


def json_cleanup(spark, sf_dir):
    return _answers(spark, sf_dir).select("doc_id", "pos", X.json_cleanup("answer").alias("cleaned"))


def json_fields_regex(spark, sf_dir):
    return _answers(spark, sf_dir).select("doc_id", "pos", X.json_fields("answer").alias("f")).select("doc_id", "pos", "f.*")


def robust_json_parse(spark, sf_dir):
    return _answers(spark, sf_dir).select("doc_id", "pos", R.parsed(F.col("answer")).alias("parsed"))


def parse_response(spark, sf_dir):
    df = _answers(spark, sf_dir).select("doc_id", "pos", R.entities(F.col("answer"), F.lit("image")).alias("e"))
    return df.select("doc_id", "pos", "e.*")


def judge_scores(spark, sf_dir):
    """Judges' answers: JSON in fences with all scores, JSON cut short, plain words with and without a negation."""
    kind, share = F.col("doc_id") % 4, (F.col("doc_id") % 5) / 4
    dims = F.concat(*(F.concat(F.lit(f', "{d}": '), share.cast("string")) for d in R.SCORES[1:]))
    good = F.col("quality") == 1
    said = (
        F.when(kind == 0, F.concat(F.lit('```json\n{"accuracy": '), F.col("quality"), dims, F.lit(', "reasoning": "as \\"expected\\""}\n```')))
        .when(kind == 1, F.concat(F.lit('{"accuracy": '), F.col("quality"), F.lit(', "relevance": 0.5, "reasoning": "so')))
        .when(kind == 2, F.when(good, "That is right.").otherwise("This is incorrect."))
        .otherwise(F.when(good, "The answer matches; it is not wrong.").otherwise("The answer is not correct."))
    )
    return table(spark, sf_dir, "labels").select("doc_id", R.judged(said).alias("j")).select("doc_id", "j.*")


def route_processors(spark, sf_dir):
    df = blocks(spark, sf_dir).select("doc_id", "pos", F.when(F.col("type") == "equation", "custom").otherwise(F.col("type")).alias("type")).where("type <> 'text'")
    return G.route(df, G.processors(spark, Config().enabled_types())).select("doc_id", "pos", "type", "processor")


def enabled_modalities(spark, sf_dir):
    df = blocks(spark, sf_dir).select("doc_id", "pos", "type").where("type <> 'text'")
    return G.route(df, G.processors(spark, Config(enable_table=False).enabled_types())).select("doc_id", "pos", "type", "processor")


def processor_supports(spark, sf_dir):
    return blocks(spark, sf_dir).select("type").distinct().select("type", F.array_join(G.supports(), ", ").alias("supports"))


def _modal(spark, sf_dir):
    """chunk_id, modal_entity_name of blocks other than text."""
    b = blocks(spark, sf_dir).where("type <> 'text'")
    return b.select(F.concat_ws("-", F.lit("chunk"), "doc_id", "pos").alias("chunk_id"), F.concat(F.col("type"), F.lit(" "), F.col("pos") % 20, F.lit(" ("), F.col("type"), F.lit(")")).alias("modal_entity_name"))


def _found(spark, sf_dir):
    """chunk_id, entity_name, entity_type, description, source_id: the words of blocks other than text, as a model might name them."""
    b = blocks(spark, sf_dir).where("type <> 'text'").withColumn("said", F.coalesce("text", "table_body", F.concat(F.col("type"), F.lit(" "), F.col("pos") % 20, F.lit(" (image)"))))
    named = F.when(F.col("type") == "image", F.array("said")).otherwise(F.filter(F.split("said", " "), lambda w: w != ""))
    b = b.select("doc_id", "pos", "type", F.explode(F.array_distinct(named)).alias("entity_name"))
    chunk = F.concat_ws("-", F.lit("chunk"), "doc_id", "pos")
    return b.select("doc_id", "pos", chunk.alias("chunk_id"), "entity_name", F.when(F.length("entity_name") > 6, "concept").otherwise(F.col("type")).alias("entity_type"), F.concat(F.lit("in "), F.col("type")).alias("description"), chunk.alias("source_id"))


def belongs_to_edges(spark, sf_dir):
    return G.belongs_to(_found(spark, sf_dir), _modal(spark, sf_dir)).select("relation_id", "src_id", "tgt_id", "keywords", "source_id", "weight")


def merge_nodes(spark, sf_dir):
    return G.merge_nodes(_found(spark, sf_dir))


def merge_edges(spark, sf_dir):
    return G.merge_edges(G.belongs_to(_found(spark, sf_dir), _modal(spark, sf_dir)))


def entity_rows(spark, sf_dir):
    """Nodes of the graph from whole answers."""
    e = R.entities(F.col("answer"), F.lit("image"))
    rows = G.entity_rows(_answers(spark, sf_dir).select(F.concat_ws("-", F.lit("chunk"), "doc_id", "pos").alias("chunk_id"), F.concat(F.lit("f"), F.col("doc_id")).alias("file_path"), e.alias("entity")))
    return rows.select("entity_id", "entity_name", "entity_type", "content", "source_id", "file_path")


def merge_full_entities(spark, sf_dir):
    """Names that a document had, its text blocks, and those that blocks of all kinds but images and headings add."""
    b = blocks(spark, sf_dir)
    names = lambda df, said: df.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", said.alias("n")))), lambda x: x["n"]).alias("entity_names"))
    old = names(b.where("type = 'text'"), F.col("text")).withColumns({"count": F.lit(1), "update_time": F.lit(111), "note": F.lit("kept")})
    new = names(b.where("type <> 'image' and text_level = 0"), F.coalesce("text", "table_body")).withColumn("update_time", F.lit(222))
    out = G.merge_full_entities(old, new)
    return out.select("doc_id", F.array_join("entity_names", "|").alias("entity_names"), "count", "update_time", "note")


def query_cache_key(spark, sf_dir):
    """Keys of users' questions with an item each; long tables count by their hash, paths by their names."""
    items = F.array(F.struct(F.lit("table").alias("type"), F.concat(F.lit("/x/"), F.col("conv_id"), F.lit("/t.png")).alias("img_path"), F.col("text").alias("table_body"), F.lit(None).cast("string").alias("text")))
    df = table(spark, sf_dir, "conversations").where("role = 'user'")
    return df.select("conv_id", "turn", Q.cache_key(F.concat(F.lit(" "), F.col("text")), items, F.lit("mix")).alias("cache_key"))


def query_cache_hits(spark, sf_dir):
    """First turns that were asked before under another conversation, by key."""
    df = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", Q.cache_key(F.col("text"), F.array(F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("img_path"), F.lit(None).cast("string").alias("table_body"), F.lit("").alias("text"))), F.lit("mix")).alias("cache_key"))
    known = df.where("turn > 0").select("cache_key").distinct().withColumn("hit", F.lit(True))
    return df.where("turn = 0").join(known, "cache_key", "left").select("conv_id", F.coalesce("hit", F.lit(False)).alias("hit"))


def enhanced_query(spark, sf_dir):
    item = lambda kind, d: F.struct(F.lit(kind).alias("type"), d.alias("description"))
    image = Q.described_image(F.when(F.col("turn") % 4 == 0, F.lit("/a.png")), F.when(F.col("turn") % 3 == 0, F.array(F.lit("c1"), F.lit("c2"))), F.lit(None).cast("array<string>"))
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", Q.enhanced(F.col("text"), F.array(item("image", image), item("table", F.when(F.col("turn") > 1, F.col("text"))))).alias("enhanced"))


def image_markers(spark, sf_dir):
    path = lambda k: F.concat(F.lit("/w/"), F.col("conv_id") + k, F.lit(".png"))
    prompt = F.concat(F.col("text"), F.lit("\nImage Path: "), path(0), F.lit("\nmore\nImage Path: /etc/x.png\nImage Path: "), path(1))
    df = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text", Q.marked(prompt, F.array(path(0), path(1))).alias("m"))
    return df.select("conv_id", "turn", F.col("m.prompt").alias("prompt"), F.array_join("m.images", ",").alias("images"))


def vlm_messages(spark, sf_dir):
    prompt = F.concat(F.col("text"), F.lit("\n[VLM_IMAGE_1] between [VLM_IMAGE_2]\n[VLM_IMAGE_9] end"))
    parts = Q.messages(prompt, F.array(F.lit("a"), F.lit("b")), F.lit("what?"))
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.posexplode(parts).alias("n", "p")).select("conv_id", "turn", "n", "p.type", F.coalesce("p.text", F.lit("")).alias("text"), F.coalesce("p.image", F.lit(-1)).alias("image"))


def analysis_prompts(spark, sf_dir):
    """What a model is asked about images in a language that has that prompt only, and its fallback for tables."""
    from ..functions.prompts import Prompts

    known = Prompts().register("de", {"image": "Bild {image_path}: {captions}"})
    df = blocks(spark, sf_dir).where("type = 'image'").withColumns({"footnotes": F.lit(None).cast("array<string>"), "extra": F.lit(None).cast("string")})
    return df.select("doc_id", "pos", known.use("de").column("image").alias("de"), known.use("de").column("table").alias("fallback"))


QUERIES = {
    f.__name__: f
    for f in (
        analysis_prompts,
        strip_thinking, json_cleanup, json_fields_regex, robust_json_parse, parse_response, judge_scores, route_processors, enabled_modalities, processor_supports, belongs_to_edges, merge_nodes, merge_edges, entity_rows,
        merge_full_entities, query_cache_key, query_cache_hits, enhanced_query, image_markers, vlm_messages,
    )
}

_VALUE = lambda name, group: f"""regexp_extract(answer, '(?s)"{name}":\\s*"((?:[^"\\\\]|\\\\.)*)"', {group})"""
_HAS = lambda name: f"{_VALUE(name, 0)} <> ''"
_THOUGHTLESS = strip_sql("regexp_replace(regexp_replace(answer, '(?is)<think>.*?</think>', '', 'g'), '(?is)<thinking>.*?</thinking>', '', 'g')")
_ENTITIES = f"""d as (select doc_id, pos, case when pos % 7 = 6 then substr(j, 2, length(j) - 2) else told end as d, {_THOUGHTLESS} as plain from answers),
entities as (select doc_id, pos, case when pos % 7 in (4, 5) then plain else d end as description, case when pos % 7 in (4, 5) then 'image_' || md5(plain) else 'E' || pos || case when pos % 7 = 6 then ' (unknown)' else ' (thing)' end end as entity_name,
  case when pos % 7 in (4, 5) then 'image' when pos % 7 = 6 then 'unknown' else 'thing' end as entity_type, case when pos % 7 in (4, 5) then left(plain, 100) || case when length(plain) > 100 then '...' else '' end when pos % 7 = 6 then left(d, 100) else 's' || doc_id end as summary from d)"""
_FOUND = """
said as (select *, coalesce(text, table_body, type || ' ' || pos % 20 || ' (image)') as said from blocks where type <> 'text'),
names as (select doc_id, pos, type, unnest(list_distinct(case when type = 'image' then [said] else list_filter(string_split(said, ' '), lambda w: w <> '') end)) as entity_name from said),
found as (select *, 'chunk-' || doc_id || '-' || pos as chunk_id, case when length(entity_name) > 6 then 'concept' else type end as entity_type, 'in ' || type as description from names),
modal as (select 'chunk-' || doc_id || '-' || pos as chunk_id, type || ' ' || pos % 20 || ' (' || type || ')' as modal_entity_name from blocks where type <> 'text'),
edges as (select md5(entity_name || modal_entity_name) as h, entity_name as src_id, modal_entity_name as tgt_id, 'belongs_to,part_of,contained_in' as keywords, chunk_id as source_id, 10.0::double as weight from found join modal using (chunk_id) where entity_name <> modal_entity_name)
"""
SQL = {
    "strip_thinking": f"with {BLOCKS}, {ANSWERS} select doc_id, pos, {_THOUGHTLESS} as cleaned from answers",
    "json_cleanup": rf"with {BLOCKS}, {ANSWERS} select doc_id, pos, regexp_replace({strip_sql('answer')}, ',(\s*[}}\]])', '\1', 'g') as cleaned from answers",
    "json_fields_regex": f"""with {BLOCKS}, {ANSWERS}, f as (select doc_id, pos, answer, case when {_HAS('detailed_description')} then {_VALUE('detailed_description', 1)} else '' end as description from answers)
        select doc_id, pos, description, case when {_HAS('entity_name')} then {_VALUE('entity_name', 1)} else 'unknown_entity' end as entity_name, case when {_HAS('entity_type')} then {_VALUE('entity_type', 1)} else 'unknown' end as entity_type, case when {_HAS('summary')} then {_VALUE('summary', 1)} else left(description, 100) end as summary from f""",
    "judge_scores": "select doc_id, quality::int as accuracy, " + ", ".join(f"case doc_id % 4 when 0 then (doc_id % 5)::double / 4 {'when 1 then 0.5::double ' * (d == 'relevance')}end as {d}" for d in R.SCORES[1:]) + """, case doc_id % 4 when 0 then 'as "expected"' when 1 then 'so' end as reasoning from labels""",
    "route_processors": f"with {BLOCKS} select doc_id, pos, case when type = 'equation' then 'custom' else type end as type, case when type = 'equation' then 'generic' else type end || '_processor' as processor from blocks where type <> 'text'",
    "enabled_modalities": f"with {BLOCKS} select doc_id, pos, type, type || '_processor' as processor from blocks where type not in ('text', 'table')",
    "processor_supports": f"with {BLOCKS} select distinct type, case type " + " ".join(f"when '{k}' then '{', '.join(v)}'" for k, v in G.SUPPORTS.items()) + f" else '{G.BASIC[0]}' end as supports from blocks",
    "belongs_to_edges": f"with {BLOCKS}, {_FOUND} select 'rel-' || h as relation_id, src_id, tgt_id, keywords, source_id, weight from edges",
    "merge_nodes": f"""with {BLOCKS}, {_FOUND}, t as (select entity_name, entity_type, count(*) as n from found group by all), b as (select entity_name, entity_type from t qualify row_number() over (partition by entity_name order by n desc, entity_type) = 1),
        a as (select entity_name, count(*) as n_mentions, count(distinct chunk_id) as n_sources, count(distinct description) as n_descriptions from found group by 1) select entity_name, entity_type, n_mentions, n_sources, n_descriptions from a join b using (entity_name)""",
    "merge_edges": f"with {BLOCKS}, {_FOUND} select least(src_id, tgt_id) as a, greatest(src_id, tgt_id) as b, sum(weight) as weight, count(*) as n_edges, count(distinct source_id) as n_sources, 3 as n_keywords from edges group by 1, 2",
    "entity_rows": f"""with {BLOCKS}, {ANSWERS}, {_ENTITIES} select 'ent-' || md5(entity_name) as entity_id, entity_name, entity_type, entity_name || chr(10) || summary as content, 'chunk-' || doc_id || '-' || pos as source_id, 'f' || doc_id as file_path from entities""",
    "merge_full_entities": f"""with {BLOCKS}, o as (select doc_id, list(text order by pos) as l from blocks where type = 'text' group by doc_id), n as (select doc_id, list(coalesce(text, table_body) order by pos) as l from blocks where type <> 'image' and text_level = 0 group by doc_id),
        m as (select coalesce(o.doc_id, n.doc_id) as doc_id, list_concat(coalesce(o.l, []), coalesce(n.l, [])) as l, n.l is not null as has_new, o.l is not null as has_old from o full join n on o.doc_id = n.doc_id),
        u as (select doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) as l, has_new, has_old from m)
        select doc_id, array_to_string(l, '|') as entity_names, len(l)::int as count, case when has_new then 222 else 111 end as update_time, case when has_old then 'kept' end as note from u""",
    "analysis_prompts": f"with {BLOCKS}, c as (select *, case when caption = '' then 'None' else caption end as captions from blocks where type = 'image') select doc_id, pos, 'Bild ' || img_path || ': ' || captions as de, {prompt_sql('table')} as fallback from c",
    "robust_json_parse": f"""with {BLOCKS}, {ANSWERS}, f as (select *, case when pos % 7 in (4, 5) then '' when pos % 7 = 6 then substr(j, 2, length(j) - 2) else told end as d from answers)
        select doc_id, pos, '{{"detailed_description": ' || to_json(d)::varchar || ', "entity_info": {{"entity_name": "' || case when pos % 7 in (4, 5) then 'unknown_entity' else 'E' || pos end || '", "entity_type": "' || case when pos % 7 > 3 then 'unknown' else 'thing' end
          || '", "summary": ' || to_json(case when pos % 7 > 3 then left(d, 100) else 's' || doc_id end)::varchar || '}}}}' as parsed from f""",
    "parse_response": f"with {BLOCKS}, {ANSWERS}, {_ENTITIES} select * from entities",
    "query_cache_key": r"""select conv_id, turn, 'multimodal_query:' || md5('{"query":' || to_json(regexp_replace(text, '^\s+|\s+$', '', 'g'))::varchar || ',"mode":"mix","items":[{"type":"table","img_path":"t.png",' ||
          case when length(text) > 200 then '"table_body_hash":"' || md5(text) || '"' else '"table_body":' || to_json(text)::varchar end || '}]}') as cache_key from conversations where role = 'user'""",
    "query_cache_hits": "with u as (select conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as t from conversations where role = 'user') select conv_id, t in (select t from u where turn > 0) as hit from u where turn = 0",
    "enhanced_query": f"""with q as (select conv_id, turn, text, case when turn % 4 = 0 and turn % 3 = 0 then 'Image path: /a.png; Image captions: c1, c2' when turn % 4 = 0 then 'Image path: /a.png' when turn % 3 = 0 then 'Image captions: c1, c2' else 'Image content information incomplete' end as i from conversations where role = 'user')
        select conv_id, turn, 'User query: ' || text || chr(10) || chr(10) || 'Related image content: ' || i || case when turn > 1 then chr(10) || chr(10) || 'Related table content: ' || text else '' end || chr(10) || chr(10) || '{Q.SUFFIX.strip()}' as enhanced from q""",
    "image_markers": "select conv_id, turn, text || chr(10) || 'Image Path: /w/' || conv_id || '.png' || chr(10) || '[VLM_IMAGE_1]' || chr(10) || 'more' || chr(10) || 'Image Path: /etc/x.png' || chr(10) || 'Image Path: /w/' || conv_id + 1 || '.png' || chr(10) || '[VLM_IMAGE_2]' as prompt, '/w/' || conv_id || '.png,/w/' || conv_id + 1 || '.png' as images from conversations where role = 'user'",
    "vlm_messages": """with q as (select conv_id, turn, text || chr(10) as t from conversations where role = 'user'), p as (select conv_id, turn, unnest([0, 1, 2, 3, 4, 5])::int as n, t from q)
        select conv_id, turn, n, case when n in (1, 3) then 'image' else 'text' end as type, case n when 0 then t when 2 then ' between ' when 4 then ' end' when 5 then chr(10) || chr(10) || 'User Question: what?' || chr(10) || chr(10) || 'Please answer based on the context and images provided.' else '' end as text, case n when 1 then 0 when 3 then 1 else -1 end::int as image from p""",
}
