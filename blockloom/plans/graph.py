"""Queries over extraction and the merge of what was said of names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extraction as E
from ..operators import graph as G
from ..operators import reduction as R
from . import stubs
from .common import BLOCKS, blocks, table
from .models import _FOUND, _found, _modal

BUDGET, SPAN, ROUNDS = 200, 8, 6


def _extracted(spark, sf_dir):
    """Documents as chunks of whole texts, read by a model that writes records."""
    chunks = table(spark, sf_dir, "documents").select(F.concat(F.lit("chunk-"), "doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("content"))
    return E.extracted(E.answers(chunks, stubs.record_writer))


def extracted_entities(spark, sf_dir):
    """Entities of whole texts from records that are broken in every way, those that a second question brought too."""
    return _extracted(spark, sf_dir).entities.select("chunk_id", "entity_name", "entity_type", "description")


def extracted_relations(spark, sf_dir):
    """Their typed, weighted relations, as rows for a vector store."""
    return E.relation_rows(_extracted(spark, sf_dir).relations).select("relation_id", "src_id", "tgt_id", "keywords", "weight", "content", "source_id")


def node_values(spark, sf_dir):
    """All that was said of each name; names are the words of blocks other than text."""
    return G.node_values(_found(spark, sf_dir))


def edge_values(spark, sf_dir):
    """All that was said of each pair of names."""
    return G.edge_values(G.belongs_to(_found(spark, sf_dir), _modal(spark, sf_dir)))


def reduced_descriptions(spark, sf_dir):
    """All lines of a source's documents, as descriptions of one name, summed up in rounds."""
    docs = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("entity_name"), F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("description"))
    return R.reduced(docs, ["entity_name"], stubs.short_sums, BUDGET, span=SPAN)


QUERIES = {f.__name__: f for f in (extracted_entities, extracted_relations, node_values, edge_values, reduced_descriptions)}

_SAID = r"""c as (select doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.\n]'), lambda s: array_to_string(regexp_extract_all(s, '[\p{L}\p{N}_]+'), ' ')), lambda s: s <> '') as l from documents),
s as (select 'chunk-' || doc_id as chunk_id, unnest(range(0, len(l)))::int as k, unnest(l) as w, unnest(list_concat(l[2:], [null])) as w2 from c),
n as (select *, left(md5(w), 8) as name, left(md5(w2), 8) as next from s)"""
_WORDS = r"greatest(1, len(list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> '')))::bigint"


def _reduced_sql() -> str:
    """Rounds of packing as windows: rN has a name's values, sN their sums, pN what the packs of names that don't fit became."""
    out = f"""with r0 as (select distinct coalesce(source, 'none') as k, unnest(string_split(coalesce(text, ''), chr(10))) as v, 0::bigint as b, 0::bigint as p, 0::bigint as calls, 1::bigint as n from documents),
r0s as (select *, {_WORDS.format('v')} as size from r0 where v <> ''),
x0 as (select * from r0s)"""
    done = []
    for i in range(ROUNDS):
        whole = "(c = 1 or total <= {})".format(BUDGET) if i == 0 else "c = 1"
        out += f""",
t{i} as (select k, count(*) as c, sum(size)::bigint as total from x{i} group by k),
m{i} as (select x{i}.*, {whole} as whole, greatest(1, least(ceil(total / {BUDGET * SPAN}.0), c // {R.FEWEST}))::bigint as nb from x{i} join t{i} using (k)),
d{i} as (select k, string_agg(v, chr(10) order by b, p, v) as v, sum(n) as n, sum(calls) as calls from m{i} where whole group by k),
u{i} as (select *, ('0x' || left(md5(v), 8))::bigint % nb as bucket from m{i} where not whole),
w{i} as (select *, least(coalesce(sum(size) over (partition by k, bucket order by b, p, v rows between unbounded preceding and 1 preceding), 0) // {BUDGET}, (row_number() over (partition by k, bucket order by b, p, v) - 1) // 2)::bigint as pack from u{i}),
g{i} as (select k, bucket as b, pack as p, count(*) as c, string_agg(v, chr(10) order by w{i}.b, w{i}.p, v) as j, sum(n) as n, sum(calls) as calls from w{i} group by k, bucket, pack),
y{i} as (select k, case when c = 1 then j else 'sum ' || left(md5('{R.ASK.split("{}")[0]}' || k || '{R.ASK.split("{}")[1].rstrip()}' || chr(10) || j), 8) end as v, b, p, (calls + (c > 1)::int)::bigint as calls, n::bigint as n from g{i}),
x{i + 1} as (select *, {_WORDS.format('v')} as size from y{i})"""
        done.append(f"select * from d{i}")
    return out + f" select k as entity_name, v as description, n::bigint as n_values, calls::bigint as n_calls, 0::bigint as n_failed from ({' union all '.join(done)})"


SQL = {
    # the longest description of a name in its chunk; the kinds of records that the stub writes: see stubs.record_writer
    "extracted_entities": f"""with {_SAID}, e as (select chunk_id, name, case when k % 2 = 1 then 'odd' else 'even' end as type, case k % 8 when 3 then '' when 4 then w || ' more ' else w end as d, case when k % 3 = 2 then 1 else 0 end as turn from n where k % 8 <> 5)
        select chunk_id, name as entity_name, type as entity_type, d as description from e qualify row_number() over (partition by chunk_id, name order by length(d) desc, turn, d, type) = 1""",
    "extracted_relations": f"""with {_SAID}, r as (select chunk_id, name as src, next as tgt, case when k % 4 = 2 then '' else name || ' before ' || next end as d, case when k % 4 = 2 then '' else 'follows,next' end as keywords, case when k % 4 = 2 or k % 5 = 4 then 1.0 else k % 10 end::double as weight
          from n where next is not null and k % 4 <> 3 and name <> next), o as (select *, max(weight) over (partition by chunk_id, src, tgt) as most from r qualify row_number() over (partition by chunk_id, src, tgt order by length(d) desc, d) = 1)
        select 'rel-' || md5(least(src, tgt) || chr(9) || greatest(src, tgt)) as relation_id, src as src_id, tgt as tgt_id, keywords, most as weight, keywords || chr(9) || src || chr(9) || tgt || chr(10) || d as content, chunk_id as source_id from o""",
    "node_values": f"with {BLOCKS}, {_FOUND} select distinct entity_name, 'description' as field, description as value from found union select entity_name, 'source_id', chunk_id from found",
    "edge_values": f"""with {BLOCKS}, {_FOUND}, p as (select *, least(src_id, tgt_id) as a, greatest(src_id, tgt_id) as b from edges) select a, b, 'description' as field, 'Entity ' || src_id || ' belongs to ' || tgt_id as value from p union select a, b, 'source_id', source_id from p
        union select a, b, 'keyword', unnest(string_split(keywords, ',')) from p""",
    "reduced_descriptions": _reduced_sql(),
}
