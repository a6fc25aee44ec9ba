"""Queries over vectors: exact search and the retrieval modes.

Queries are the rows whose id is divisible by 100, searched among all rows. For the modes, vectors stand for chunks and
for entities of equal number; entities are tied in rings of ten (edge e joins e and e + 1, or the ring's first)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import models
from ..functions import text as X
from ..operators import retrieval as R
from ..operators import vectors as V
from ..shared import shared_folder
from .common import table

K, THRESHOLD = 60, 0.2
BUDGETS = {"entities": 12, "relations": 20, "texts": 1500}
TITLES = {"entities": "Entities:", "relations": "Relations:", "texts": "Texts:"}


def _search(spark, sf_dir, k=K, threshold=None, same=None):
    v = table(spark, sf_dir, "embeddings")
    return R.top_k(v.where("vec_id % 100 = 0"), v, k, threshold, same=same)


def vector_topk(spark, sf_dir):
    return _search(spark, sf_dir)


def vector_index_topk(spark, sf_dir):
    """The same of an index that is written first, in its exact mode."""
    v, folder = table(spark, sf_dir, "embeddings"), f"{shared_folder(spark)}/index-{uuid.uuid4()}"
    V.build_index(v, folder)
    return V.search_index(spark, folder, v.where("vec_id % 100 = 0"), K)


def vector_threshold(spark, sf_dir):
    return _search(spark, sf_dir, threshold=THRESHOLD)


def knn_per_label(spark, sf_dir):
    return _search(spark, sf_dir, 5, same="label")


def _graph(spark, sf_dir):
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("a"))
    edges = ids.select(F.col("a").alias("edge_id"), "a", F.when(F.col("a") % 10 == 9, F.col("a") - 9).otherwise(F.col("a") + 1).alias("b"))
    return edges, ids.select(F.col("a").alias("entity"), (F.col("a") * 7 % 1000).alias("chunk_id"))


def _naive(spark, sf_dir):
    return R.naive(_search(spark, sf_dir, 20, THRESHOLD))


def _local(spark, sf_dir):
    return R.local(_search(spark, sf_dir, 10, THRESHOLD), *_graph(spark, sf_dir))


def _global(spark, sf_dir):
    return R.global_(_search(spark, sf_dir, 5, THRESHOLD), *_graph(spark, sf_dir))


def retrieval_naive(spark, sf_dir):
    return R.ranked(_naive(spark, sf_dir), K)


def retrieval_local(spark, sf_dir):
    return R.ranked(_local(spark, sf_dir), K)


def retrieval_global(spark, sf_dir):
    return R.ranked(_global(spark, sf_dir), K)


def retrieval_hybrid(spark, sf_dir):
    return R.ranked(R.both(_local(spark, sf_dir), _global(spark, sf_dir)), K)


def retrieval_mix(spark, sf_dir):
    return R.ranked(R.both(_local(spark, sf_dir), _global(spark, sf_dir), _naive(spark, sf_dir)), K)


def _sections(spark, sf_dir):
    """What was found for each question: entities by vector, the edges to those beside them, whole texts of documents."""
    edges, _ = _graph(spark, sf_dir)
    hits = _search(spark, sf_dir, 10, THRESHOLD)
    entities = hits.select("query_id", F.lit("entities").alias("section"), "rank", F.concat(F.lit("entity "), "vec_id").alias("text"))
    near = hits.join(R.neighbours(edges.withColumn("weight", F.col("edge_id") % 7 + 1.0), 2), F.col("vec_id") == F.col("entity"))
    relations = near.select("query_id", F.lit("relations").alias("section"), (F.col("rank") * 10 + F.col("nth")).alias("rank"), F.concat_ws(" ", "entity", "beside", F.col("weight").cast("int")).alias("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chunks = R.ranked(_naive(spark, sf_dir), K).join(docs, F.col("chunk_id") == F.col("doc_id")).select("query_id", F.lit("texts").alias("section"), "rank", "text")
    found = entities.unionByName(relations).unionByName(chunks)
    return found.withColumn("tokens", X.tokens("text"))


def model_rerank(spark, sf_dir):
    """Whole texts found for a question, ranked anew by a model over both; a question's text is the document of its number."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("content"))
    questions = docs.select(F.col("chunk_id").alias("query_id"), F.col("content").alias("question"))
    return R.reranked(R.ranked(_naive(spark, sf_dir), K), questions, docs, models.stub_overlap, 10)


def packed_context(spark, sf_dir):
    """Entities, relations and whole texts as far as each section's budget goes."""
    kept = R.packed(_sections(spark, sf_dir), BUDGETS)
    return kept.select("query_id", "section", "rank", "tokens", "used", F.md5("text").alias("text_md5"))


def context_prompts(spark, sf_dir):
    """The same as one text for each question."""
    return R.context(R.packed(_sections(spark, sf_dir), BUDGETS), TITLES).select("query_id", F.md5("context").alias("context_md5"))


def retrieval_bypass(spark, sf_dir):
    """No retrieval: queries go on as they are."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"))


def rerank(spark, sf_dir):
    """The best by a second score, here nearness of ids."""
    return R.rerank(_naive(spark, sf_dir), -F.abs(F.col("query_id") - F.col("chunk_id")).cast("double"), 5)


QUERIES = {f.__name__: f for f in (vector_topk, vector_index_topk, vector_threshold, knn_per_label, retrieval_naive, retrieval_local, retrieval_global, retrieval_hybrid, retrieval_mix, retrieval_bypass, rerank, model_rerank, packed_context, context_prompts)}

_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1] * p[2]))"
_ALL = f"""
e as (select vec_id, label, embedding::double[] as v, sqrt({_DOT.format('embedding::double[]', 'embedding::double[]')}) as n from embeddings),
s as (select q.vec_id as query_id, x.vec_id, q.label = x.label as same, round({_DOT.format('q.v', 'x.v')} / (q.n * x.n), 6) as score from e q join e x on q.vec_id % 100 = 0 and q.vec_id <> x.vec_id)
"""


def _top(k: int, where: str = "true") -> str:
    return f"(select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s where {where} qualify rank <= {k})"


_SETS = f"""{_ALL},
edges as (select vec_id as edge_id, vec_id as a, case when vec_id % 10 = 9 then vec_id - 9 else vec_id + 1 end as b from embeddings), chunks as (select vec_id as entity, vec_id * 7 % 1000 as chunk_id from embeddings),
naive as (select query_id, vec_id as chunk_id, score from {_top(20, f'score >= {THRESHOLD}')}),
eh as (select query_id, vec_id as entity, score from {_top(10, f'score >= {THRESHOLD}')}), ends as (select a, b from edges union select b, a from edges),
loc as (select query_id, chunk_id, max(score) as score from (select * from eh union all select query_id, b, score from eh join ends on entity = a) join chunks using (entity) group by all),
rh as (select query_id, vec_id as edge_id, score from {_top(5, f'score >= {THRESHOLD}')}),
glo as (select query_id, chunk_id, max(score) as score from (select query_id, unnest([a, b]) as entity, score from rh join edges using (edge_id)) join chunks using (entity) group by all)
"""


def _ranked(rows: str) -> str:
    return f"with {_SETS}, f as (select query_id, chunk_id, max(score) as score from ({rows}) group by all) select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from f qualify rank <= {K}"


_PACKED_SQL = f"""with {_SETS}, w as (select a, b, sum(weight) as weight from (select a, b, edge_id % 7 + 1.0 as weight from edges where a <> b union all select b, a, edge_id % 7 + 1.0 from edges where a <> b) group by a, b),
d as (select a as b, count(*) as degree from w group by a), near as (select w.a, w.b, weight, row_number() over (partition by w.a order by weight desc, degree desc, w.b) as nth from w join d on w.b = d.b qualify nth <= 2),
h as (select query_id, vec_id, rank from {_top(10, f'score >= {THRESHOLD}')}), t as (select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from naive qualify rank <= {K}),
f as (select query_id, 'entities' as section, rank, 'entity ' || vec_id as text from h union all select query_id, 'relations', rank * 10 + nth, a || ' ' || b || ' ' || weight::int from h join near on vec_id = a
  union all select query_id, 'texts', rank, coalesce(text, '') from t join documents on chunk_id = doc_id),
n as (select *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::int as tokens from f),
u as (select query_id, section, rank::int as rank, text, tokens, sum(tokens) over (partition by query_id, section order by rank)::bigint as used from n),
kept as (select * from u where used <= case section {' '.join(f"when '{k}' then {n}" for k, n in BUDGETS.items())} end)"""
_TITLE_SQL = "case section " + " ".join(f"when '{k}' then '{t}'" for k, t in TITLES.items()) + " end"
SQL = {
    "vector_topk": f"with {_ALL} select * from {_top(K)}",
    "vector_index_topk": f"with {_ALL} select * from {_top(K)}",
    "vector_threshold": f"with {_ALL} select * from {_top(K, f'score >= {THRESHOLD}')}",
    "knn_per_label": f"with {_ALL} select * from {_top(5, 'same')}",
    "retrieval_naive": _ranked("from naive"),
    "retrieval_local": _ranked("from loc"),
    "retrieval_global": _ranked("from glo"),
    "retrieval_hybrid": _ranked("from loc union all from glo"),
    "retrieval_mix": _ranked("from loc union all from glo union all from naive"),
    "retrieval_bypass": "select vec_id as query_id from embeddings where vec_id % 100 = 0",
    "rerank": f"with {_SETS} select query_id, chunk_id, -abs(query_id - chunk_id)::double as score, row_number() over (partition by query_id order by abs(query_id - chunk_id), chunk_id)::int as rank from naive qualify rank <= 5",
    "model_rerank": f"""with {_SETS}, w as (select doc_id, list_distinct(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\r\\n]+'), lambda x: x <> '')) as w from documents),
        o as (select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) as before from naive qualify before <= {K}),
        m as (select o.*, case when t.doc_id is not null then round(len(list_intersect(q.w, t.w)) / greatest(1, len(q.w))::double, 6) end as score from o join w q on q.doc_id = query_id left join w t on t.doc_id = chunk_id)
        select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc nulls last, before, chunk_id)::int as rank from m qualify rank <= 10""",
    "packed_context": f"{_PACKED_SQL} select query_id, section, rank, tokens, used, md5(text) as text_md5 from kept",
    "context_prompts": f"""{_PACKED_SQL}, sec as (select query_id, {_TITLE_SQL} as title, string_agg(text, chr(10) order by rank) as body, case section when 'entities' then 0 when 'relations' then 1 else 2 end as place from kept group by query_id, section)
        select query_id, md5(string_agg(title || chr(10) || body, chr(10) || chr(10) order by place)) as context_md5 from sec group by query_id""",
}
