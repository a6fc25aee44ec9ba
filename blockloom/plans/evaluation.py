"""Queries over evaluations, status, batches, caches and events.

labels stand for judged answers: quality for accuracy, the document's source for the method, its language for the file."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import metrics as M
from ..operators import status as S
from ..operators.tables import KeyedTable
from ..shared import shared_folder
from .common import BLOCKS, blocks, table


def results(spark, sf_dir):
    """One row for each judged answer."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    df = table(spark, sf_dir, "labels").join(docs, "doc_id")
    kinds = F.array(*map(F.lit, ("manual", "survey", "10k", "paper", "handbook")))
    dims = [F.when((F.col("doc_id") + k) % 4 != 0, ((F.col("doc_id") * (k + 3)) % 11) / 10.0).alias(d) for k, d in enumerate(E.DIMENSIONS)]
    return df.select(
        F.concat((F.col("doc_id") % 50).cast("string"), F.when(F.col("doc_id") % 3 == 0, "").otherwise("/"), F.element_at(kinds, (F.col("doc_id") % 50 % 5 + 1).cast("int"))).alias("doc_id"), F.concat(F.lit("q"), F.col("doc_id")).alias("question"),
        F.element_at(F.array(*map(F.lit, E.MODES)), (F.col("doc_id") % 4 + 1).cast("int")).alias("method"), F.col("lang").alias("source_file"), F.when(F.col("doc_id") % 10 != 0, F.col("quality")).alias("accuracy"), *dims,
        (F.col("toxic") == 0).alias("success"), (F.col("n_chars") / 1000.0).alias("evaluation_time"), F.when(F.col("doc_id") % 7 == 0, "arXiv pages").otherwise("text").alias("evidence_sources"),
    )


def eval_by_method(spark, sf_dir):
    return E.by(results(spark, sf_dir), "method")


def eval_dimensions(spark, sf_dir):
    return E.dimensions(results(spark, sf_dir), "method")


def eval_comparison(spark, sf_dir):
    return E.comparison(results(spark, sf_dir))


def eval_source_method(spark, sf_dir):
    return E.by(results(spark, sf_dir), "source_file", "method")


def eval_doc_method(spark, sf_dir):
    return E.by_document(results(spark, sf_dir))


def eval_doc_type(spark, sf_dir):
    return E.by_doc_type(results(spark, sf_dir))


def eval_totals(spark, sf_dir):
    return E.totals(results(spark, sf_dir))


def eval_pending(spark, sf_dir):
    r = results(spark, sf_dir)
    return E.pending(r.select(*E.KEYS), r)


def eval_existing(spark, sf_dir):
    r = results(spark, sf_dir)
    return E.existing(r.select(*E.KEYS), r)


def eval_replace(spark, sf_dir):
    """Judged again: all of one method, with reversed accuracy."""
    r = results(spark, sf_dir).select(*E.KEYS, "accuracy")
    return E.replaced(r, r.where("method = 'mix'").withColumn("accuracy", 1 - F.col("accuracy")))


def _modes(spark, sf_dir):
    d = F.col("doc_id")
    r = lambda k: F.when(d % (k + 2) != 0, F.struct((d % (k + 5) != 0).alias("success"), F.when(d % (k + 7) == 0, F.concat(F.lit("context_length_exceeded at "), d)).alias("error")))
    top = F.when(d % 20 == 0, "Document not found").when(d % 20 == 1, F.repeat(F.lit("bad "), 20))
    return table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), d).alias("question"), top.alias("error"), *(r(k).alias(f"{m}_result") for k, m in enumerate(E.MODES)))


def eval_errors(spark, sf_dir):
    return _modes(spark, sf_dir).where(E.has_error()).select("doc_id", E.error_summary().alias("summary"))


def eval_unpivot(spark, sf_dir):
    return E.unpivoted(_modes(spark, sf_dir)).select("doc_id", "method", "success", F.coalesce("error", F.lit("")).alias("error"))


def eval_doc_sort(spark, sf_dir):
    """Documents in order of their folder's number; the order is a column, as results are compared as sets."""
    from pyspark.sql import Window as W

    docs = results(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n")).withColumn("folder", E.folder_number("doc_id"))
    return docs.select("doc_id", "n", "folder", F.row_number().over(W.partitionBy("folder").orderBy("doc_id")).alias("nth"))


def eval_limit_per_file(spark, sf_dir):
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("source_file").orderBy("question"))
    return results(spark, sf_dir).select("source_file", "question", rank.alias("nth")).where("nth <= 5")


def eval_summary(spark, sf_dir):
    """Rows as a report has them: long texts cut."""
    from ..functions.text import shorten

    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", shorten(t, 100).alias("question"), shorten(F.reverse(t), 200).alias("reasoning"))


def batch_summary(spark, sf_dir):
    return S.batch_summary(table(spark, sf_dir, "documents").select("source", (F.col("doc_id") % 3 != 0).alias("ok")), "source")


def _status(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("ready", "handling", "pending", "processing", "processed", "failed")))
    return table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.first("quality").alias("quality")).select("doc_id", F.element_at(kinds, (F.col("doc_id") % 6 + 1).cast("int")).alias("status"), (F.col("quality") == 1).alias("multimodal_processed"), (F.col("doc_id") % 9).cast("int").alias("chunks_count"))


def doc_status(spark, sf_dir):
    return S.projection(table(spark, sf_dir, "documents").select("doc_id"), _status(spark, sf_dir))


def multimodal_gate(spark, sf_dir):
    return S.gate(table(spark, sf_dir, "documents").select("doc_id"), _status(spark, sf_dir))


def chunk_status(spark, sf_dir):
    c = blocks(spark, sf_dir).select("doc_id", F.col("pos").alias("chunk_order_index"), F.concat_ws("-", F.lit("c"), "doc_id", "pos").alias("chunk_id"))
    return S.document_status(c).select("doc_id", "status", "chunks_count", F.md5(F.array_join("chunks_list", ",")).alias("chunks_md5"))


def upsert_latest(spark, sf_dir):
    """Turns by conversation and role: the last of a role replaces the rows of its key."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", F.col("turn").alias("_pos"))
    old = t.where("turn = 0").drop("_pos").withColumn("turn", F.lit(-1).cast("long"))
    return S.upsert(old, t.where("turn > 0"), ["conv_id", "role"])


def parse_cache_hits(spark, sf_dir):
    from ..operators.queries import parse_key

    f = table(spark, sf_dir, "pages").select("page_id", parse_key(F.col("url"), F.lit(1), F.lit("mineru"), F.lit("auto")).alias("cache_key"), (F.col("page_id") % 3).alias("mtime"), F.lit("auto").alias("parse_config"))
    cache = f.where("page_id % 2 = 0").select("cache_key", F.lit(1).alias("mtime"), "parse_config").dropDuplicates(["cache_key"])
    return S.cache_hits(f, cache).select("page_id", "cache_key", "hit")


def event_metrics(spark, sf_dir):
    return M.accumulate(table(spark, sf_dir, "events"), "user_id")


def error_log_top5(spark, sf_dir):
    return M.first_errors(table(spark, sf_dir, "events")).select("user_id", "event_id", F.col("nth"), "value")


def event_windows_tumbling(spark, sf_dir):
    return M.windows(table(spark, sf_dir, "events"), "1 hour")


def event_windows_sliding(spark, sf_dir):
    return M.windows(table(spark, sf_dir, "events"), "2 hours", "1 hour")


def event_sessions(spark, sf_dir):
    return M.sessions(table(spark, sf_dir, "events"), "30 minutes")


def breaker_states(spark, sf_dir):
    from ..streaming.streams import breaker_table

    return breaker_table(table(spark, sf_dir, "events"))


def stream_event_windows(spark, sf_dir):
    """The tumbling windows, from a stream of the same events."""
    from ..streaming import streams

    return streams.drained(streams.windowed(streams.event_stream(spark, sf_dir), "1 hour")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def stream_once_each(spark, sf_dir):
    """Events delivered twice, counted once."""
    from ..streaming import streams

    s = streams.event_stream(spark, sf_dir)
    return streams.drained(streams.once_each(s.unionByName(s), late="100 days").select("event_id", "event_type"), "append")


def stream_breakers(spark, sf_dir):
    """Breakers as keyed state of a stream of the same events."""
    from ..streaming import streams

    return streams.drained(streams.breaker_stream(streams.event_stream(spark, sf_dir)), "update", ("user_id",)).select("user_id", "n_failures", "state", "n_rejected")


def table_upserts(spark, sf_dir):
    """Turns by conversation and role, upserted in three parts into a keyed table; the last of a role stays."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", "text", F.col("turn").alias("_pos"))
    kept = KeyedTable(spark, f"{shared_folder(spark)}/table-{uuid.uuid4()}", ["conv_id", "role"], 16)
    for part in ("turn < 2", "turn >= 2 and conv_id % 3 = 0", "turn >= 2 and conv_id % 3 <> 0"):
        kept.upsert(turns.where(part))
    return kept.read()


def incremental_files(spark, sf_dir):
    """Pages as files that a stream lists three times; those that changed between are read again and replace their rows.

    Pages may share an address, or have none, so each is a file of its own: its path ends in its number until the rows are read."""
    from ..streaming import incremental

    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.concat_ws("#", "url", "page_id").alias("path"), F.coalesce("html", F.lit("")).alias("html"))
    folder = f"{shared_folder(spark)}/listing-{uuid.uuid4()}"
    kept = KeyedTable(spark, f"{folder}/table", ["path"], 16)
    read = lambda changed: changed.join(pages, "path").select("path", "mtime", "page_id", "url", F.posexplode(F.split("html", "\n")).alias("pos", "line"))
    for n, changed in ((1, F.lit(True)), (2, F.col("page_id") % 3 == 0), (3, F.col("page_id") % 5 == 0)):
        before = F.when((F.lit(n) > 2) & (F.col("page_id") % 3 == 0), 2).otherwise(1)
        pages.select("path", F.when(changed, n).otherwise(before).cast("long").alias("mtime")).write.parquet(f"{folder}/in/{n}")
        stream = spark.readStream.schema("path string, mtime long").option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        incremental.ingest_changes(stream, read, kept, f"{folder}/state").awaitTermination()
    return kept.read().select(F.col("url").alias("path"), "mtime", "page_id", "pos", "line")


QUERIES = {
    f.__name__: f
    for f in (
        stream_breakers, table_upserts, incremental_files,
        eval_by_method, eval_dimensions, eval_comparison, eval_source_method, eval_doc_method, eval_doc_type, eval_totals, eval_pending, eval_existing, eval_replace, eval_errors, eval_unpivot, eval_doc_sort, eval_limit_per_file, eval_summary,
        batch_summary, doc_status, multimodal_gate, chunk_status, upsert_latest, parse_cache_hits, event_metrics, error_log_top5, event_windows_tumbling, event_windows_sliding, event_sessions, breaker_states, stream_event_windows, stream_once_each,
    )
}

_DIMS = ", ".join(f"case when (doc_id + {k}) % 4 <> 0 then ((doc_id * {k + 3}) % 11) / 10.0 end as {d}" for k, d in enumerate(E.DIMENSIONS))
_RESULTS = f"""
r as (select doc_id % 50 || case when doc_id % 3 = 0 then '' else '/' end || ['manual', 'survey', '10k', 'paper', 'handbook'][(doc_id % 50 % 5 + 1)::int] as doc_id, 'q' || doc_id as question, ['vlm', 'hybrid', 'mix', 'naive'][(doc_id % 4 + 1)::int] as method, lang as source_file,
  case when doc_id % 10 <> 0 then quality end as accuracy, {_DIMS}, toxic = 0 as success, n_chars / 1000.0 as evaluation_time, case when doc_id % 7 = 0 then 'arXiv pages' else 'text' end as evidence_sources from labels join documents using (doc_id))
"""
_BY = "count(*) as n_evaluated, sum(accuracy)::bigint as n_correct, round(avg(accuracy) * 100, 6) as accuracy"
_MEANS = ", ".join(f"round(avg({d}), 6) as {d}" for d in E.DIMENSIONS)
_MEANS0 = ", ".join(f"round(coalesce(avg({d}), 0.0), 6) as {d}" for d in ("accuracy", *E.DIMENSIONS))
_TYPE = "case when lower(evidence_sources) like '%arxiv%' then 'Academic paper' when lower(doc_id) like '%10k%' then 'Financial report' when regexp_matches(lower(doc_id), 'manual|guide|handbook') then 'Manual / guide' when regexp_matches(lower(doc_id), 'report|survey') then 'Research report' else 'Other' end"
_DONE = "exists (select 1 from r d where d.success and d.accuracy is not null and d.doc_id = r.doc_id and d.question = r.question and d.method = r.method)"
_MODES_SQL = "m as (select doc_id, case when doc_id % 20 = 0 then 'Document not found' when doc_id % 20 = 1 then repeat('bad ', 20) end as top, " + ", ".join(f"doc_id % {k + 2} <> 0 as has{k}, doc_id % {k + 5} <> 0 as ok{k}, case when doc_id % {k + 7} = 0 then 'context_length_exceeded at ' || doc_id end as e{k}" for k in range(4)) + " from labels)"
_FAIL = lambda k: f"has{k} and (not ok{k} or e{k} is not null)"
_TOLD = ", ".join(
    ["case when lower(top) like '%document not found%' then 'Document not found' when top is not null then 'Top-level error: ' || left(top, 50) || '...' end"]
    + [f"case when {_FAIL(k)} then {'case when e0 is not null then ' + repr('VLM token limit exceeded') + ' else ' if k == 0 else ''}'{n} error: ' || left(coalesce(e{k}, '{n} query failed'), 50) || '...'{' end' if k == 0 else ''} end" for k, n in enumerate(("VLM", "Hybrid", "Mix", "Naive"))]
)
_STATUS = "st as (select distinct on (doc_id) doc_id, ['ready', 'handling', 'pending', 'processing', 'processed', 'failed'][(doc_id % 6 + 1)::int] as status, quality = 1 as mm, (doc_id % 9)::int as chunks_count from labels)"
_READY = "coalesce(e.at - a.l >= 3600000000, false)"
_NOW = f"(case when a.s = 'open' and {_READY} then 'half-open' else a.s end)"
_FAILED = f"(case when {_NOW} = 'open' then a.f when e.ok then 0 when {_NOW} = 'half-open' then 3 when {_READY} then 1 else a.f + 1 end)"
_ROLE = lambda n: f"event_type = '{n}'"
SQL = {
    "eval_by_method": f"with {_RESULTS} select method, {_BY} from r where accuracy is not null group by method",
    "eval_dimensions": f"with {_RESULTS} select method, {_MEANS} from r group by method having count(relevance) > 0",
    "eval_comparison": f"with {_RESULTS} select method, count(accuracy) as n_evaluated, {_MEANS0} from r where (select count(distinct method) from r) > 1 group by method",
    "eval_source_method": f"with {_RESULTS} select source_file, method, {_BY} from r where accuracy is not null group by all",
    "eval_doc_method": f"with {_RESULTS}, d as (select doc_id, method, {_BY} from r where accuracy is not null group by all) select *, count(*) over (partition by doc_id) as n_methods from d",
    "eval_doc_type": f"with {_RESULTS}, d as (select doc_id, avg(accuracy) as a, string_agg(distinct {_TYPE}, ', ' order by {_TYPE}) as doc_type from r where accuracy is not null group by doc_id) select doc_type, count(*) as n_documents, round(avg(a) * 100, 6) as accuracy from d group by doc_type",
    "eval_totals": f"with {_RESULTS} select count(*) as total, count(*) filter (success) as succeeded, count(*) filter (not success) as failed, round(avg(evaluation_time) filter (success), 6) as mean_time from r having count(*) filter (success) > 0",
    "eval_pending": f"with {_RESULTS} select doc_id, question, method from r where not {_DONE}",
    "eval_existing": f"with {_RESULTS} select doc_id, question, method from r where {_DONE}",
    "eval_replace": f"with {_RESULTS} select doc_id, question, method, case when method = 'mix' then 1 - accuracy else accuracy end as accuracy from r",
    "eval_errors": f"with {_MODES_SQL} select doc_id, concat_ws('; ', {_TOLD}) as summary from m where top is not null or {' or '.join(_FAIL(k) for k in range(4))}",
    "eval_unpivot": f"with {_MODES_SQL} " + " union all ".join(f"select doc_id, '{n}' as method, ok{k} as success, coalesce(e{k}, '') as error from m where has{k}" for k, n in enumerate(E.MODES)),
    "eval_doc_sort": f"with {_RESULTS}, d as (select doc_id, count(*) as n, coalesce(try_cast(regexp_extract(doc_id, '^([0-9]+)/', 1) as bigint), 1000000000) as folder from r group by doc_id) select *, row_number() over (partition by folder order by doc_id)::int as nth from d",
    "eval_limit_per_file": f"with {_RESULTS} select source_file, question, row_number() over (partition by source_file order by question)::int as nth from r qualify nth <= 5",
    "eval_summary": "with d as (select doc_id, coalesce(text, '') as t from documents) select doc_id, case when length(t) > 100 then left(t, 100) || '...' else t end as question, case when length(t) > 200 then left(reverse(t), 200) || '...' else reverse(t) end as reasoning from d",
    "batch_summary": "select source, count(*) as n_files, count(*) filter (doc_id % 3 <> 0) as n_ok, count(*) filter (doc_id % 3 = 0) as n_failed, round(count(*) filter (doc_id % 3 <> 0) * 100.0 / count(*), 6) as success_rate from documents group by source",
    "doc_status": f"with {_STATUS} select d.doc_id, st.doc_id is not null as exists, coalesce(status = 'processed', false) as text_processed, coalesce(mm, false) as multimodal_processed, coalesce(status = 'processed' and mm, false) as fully_processed, coalesce(chunks_count, 0)::int as chunks_count from documents d left join st on d.doc_id = st.doc_id",
    "multimodal_gate": f"with {_STATUS} select doc_id from documents where doc_id not in (select doc_id from st where mm)",
    "chunk_status": f"with {BLOCKS} select doc_id, 'processed' as status, count(*) as chunks_count, md5(string_agg('c-' || doc_id || '-' || pos, ',' order by pos)) as chunks_md5 from blocks group by doc_id",
    "upsert_latest": "with n as (select conv_id, role, max(turn) as turn from conversations where turn > 0 group by all) select * from n union all select conv_id, role, -1::bigint from conversations c where turn = 0 and not exists (select 1 from n where n.conv_id = c.conv_id and n.role = c.role)",
    "parse_cache_hits": "with f as (select page_id, md5(url || '|1|mineru|auto') as cache_key from pages) select page_id, cache_key, page_id % 3 = 1 and cache_key in (select cache_key from f where page_id % 2 = 0) as hit from f",
    "event_metrics": f"select user_id, count(*) filter ({_ROLE('purchase')}) as documents_processed, count(*) filter ({_ROLE('error')}) as documents_failed, round(coalesce(sum(value) filter ({_ROLE('view')}), 0.0), 4) as total_parse_time, round(coalesce(sum(value) filter ({_ROLE('signup')}), 0.0), 4) as total_insert_time, count(*) filter ({_ROLE('click')}) as queries_executed, round(coalesce(sum(value) filter ({_ROLE('click')}), 0.0), 4) as total_query_time from events group by user_id",
    "error_log_top5": "select user_id, event_id, row_number() over (partition by user_id order by ts, event_id)::int as nth, value from events where event_type = 'error' qualify nth <= 5",
    "event_windows_tumbling": "select event_type, time_bucket(interval '1 hour', ts) as window_start, count(*) as n, round(sum(value), 4) as total from events group by all",
    "event_windows_sliding": "with w as (select event_type, value, time_bucket(interval '1 hour', ts) - unnest([0, 1]) * interval '1 hour' as window_start from events) select event_type, window_start, count(*) as n, round(sum(value), 4) as total from w group by all",
    "event_sessions": "with g as (select user_id, ts, coalesce(ts - lag(ts) over (partition by user_id order by ts) >= interval '30 minutes', true)::int as new from events), s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from g) select user_id, min(ts) as session_start, count(*) as n from s group by user_id, s",
    "breaker_states": f"""with e as (select user_id, list({{'f': 0, 's': 'closed', 'l': null::bigint, 'r': 0::bigint, 'at': epoch_us(ts), 'ok': event_type <> 'error'}} order by ts, event_id) as l from events group by user_id),
        b as (select user_id, list_reduce(l, lambda a, e: {{'f': {_FAILED}, 's': case when {_NOW} = 'open' then 'open' when e.ok then 'closed' when {_FAILED} >= 3 then 'open' else 'closed' end,
          'l': case when {_NOW} <> 'open' and not e.ok then e.at else a.l end, 'r': a.r + ({_NOW} = 'open')::bigint, 'at': e.at, 'ok': e.ok}}, {{'f': 0, 's': 'closed', 'l': null::bigint, 'r': 0::bigint, 'at': 0::bigint, 'ok': true}}) as b from e)
        select user_id, b.f::int as n_failures, b.s as state, b.r as n_rejected from b""",
    "stream_event_windows": "select event_type, time_bucket(interval '1 hour', ts) as window_start, count(*) as n, round(sum(value), 4) as total from events group by all",
    "stream_once_each": "select event_id, event_type from events",
    "table_upserts": "select conv_id, role, turn, text from conversations qualify row_number() over (partition by conv_id, role order by turn desc) = 1",
    "incremental_files": """with p as (select url as path, case when page_id % 5 = 0 then 3 when page_id % 3 = 0 then 2 else 1 end::bigint as mtime, page_id, string_split(coalesce(html, ''), chr(10)) as l from pages)
        select path, mtime, page_id, unnest(range(0, len(l)))::int as pos, unnest(l) as line from p""",
}
SQL["stream_breakers"] = SQL["breaker_states"]
