"""Queries over sources and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import IMAGE, PDF, TEXT
from ..functions import text as X
from ..operators import blocks as B
from ..sources import blocks as source
from ..sources import files
from .common import BLOCKS, docs, hash_sql, strip_sql, table

ITEM_SIGNATURE = f"""case when type = 'text' and text <> '' then {strip_sql('text')} when type = 'image' and img_path <> '' then 'image:' || img_path when type = 'table' and table_body <> '' then 'table:' || table_body
  when type = 'equation' and text <> '' then 'equation:' || text else '{{"type":"' || type || '","page_idx":' || page_idx || coalesce(',"text":' || to_json(text)::varchar, '') || ',"text_level":' || text_level || coalesce(',"img_path":"' || img_path || '"', '') || coalesce(',"captions":[' || to_json(caption)::varchar || ']', '')
    || coalesce(',"table_body":' || to_json(table_body)::varchar, '') || case when text_format <> '' then ',"text_format":"latex"' else '' end || '}}' end"""


def ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = B.separate(docs(spark, sf_dir))
    return df.select("doc_id", B.content_id("blocks").alias("content_id"), F.length("text_content").cast("long").alias("text_len"), F.size("blocks").cast("long").alias("n_blocks"), F.size("items").cast("long").alias("n_multimodal"))


def separate_content(spark, sf_dir):
    return B.separate(docs(spark, sf_dir)).select("doc_id", "text_content", F.size("items").cast("long").alias("n_items"))


def block_type_counts(spark, sf_dir):
    return B.type_counts(docs(spark, sf_dir))


def content_doc_id(spark, sf_dir):
    """Ids of documents with blocks of types of their own and with images that have no path."""
    own = F.transform("blocks", lambda b: F.when((b["pos"] % 8 == 0) & (b["type"] == "text"), b.withField("type", F.lit("note"))).when(b["pos"] % 2 == 0, b.withField("img_path", F.lit(None).cast("string"))).otherwise(b))
    return docs(spark, sf_dir).select("doc_id", B.content_id(own).alias("content_id"))


def text_recovery(spark, sf_dir):
    """Documents whose text blocks were lost: the text of other blocks takes their place."""
    lost = docs(spark, sf_dir).withColumn("blocks", F.filter("blocks", lambda b: b["type"] != "text"))
    return B.recovered(lost).select("doc_id", "text_content")


def normalize_nested(spark, sf_dir):
    """Sentences of lines: a list of lists laid open in order."""
    nested = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.split(x, r"\. "))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.flatten(nested)).alias("pos", "item"))


def file_reference(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", "/srv/"), r"[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", X.basename(path).alias("name"), X.relative_path(path, "/srv").alias("relative"), X.extension(path).alias("ext"), files.route(path).alias("kind"), X.is_url("url").alias("is_url"))


def supported_files(spark, sf_dir):
    """Pages' paths with endings of all kinds and cases."""
    endings = F.array(*map(F.lit, (".pdf", ".PNG", ".csv", ".py", ".Md", ".docx", "")))
    df = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/in"), _path(), F.element_at(endings, (F.col("page_id") % 7 + 1).cast("int"))).alias("path"))
    return files.supported(df, tuple(sorted({*PDF, *IMAGE, *TEXT})))


def _path():
    """The path in a page's address."""
    return F.coalesce(F.expr("parse_url(url, 'PATH')"), F.lit("/"))


def url_sources(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.lower(F.expr("parse_url(url, 'PROTOCOL')")).alias("scheme"), F.expr("parse_url(url, 'HOST')").alias("host"), F.expr("parse_url(url, 'PATH')").alias("path")).where("host is not null")


def guarded_images(spark, sf_dir):
    path = F.concat(F.element_at(F.array(*map(F.lit, ("images/", "../", "/data/doc/x/../", "/etc/", "./a/./"))), (F.col("page_id") % 5 + 1).cast("int")), F.substring(_path(), 2, 1 << 30), F.lit(".png"))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("given"), files.guarded_image(path, "/data/doc").alias("img_path"), files.valid_image(path, F.col("page_id") * (1 << 20), 100).alias("valid"))


def output_folders(spark, sf_dir):
    from ..operators.status import output_folder

    path = F.concat(F.lit("/in/"), F.col("page_id") % 3, _path(), F.lit(".v1.pdf"))
    return table(spark, sf_dir, "pages").select("page_id", output_folder(path).alias("folder"))


def markdown_blocks(spark, sf_dir):
    marked = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.concat(F.repeat(F.lit("#"), (i % 4).cast("int")), F.lit(" "), x)), "\n")
    return source.markdown(table(spark, sf_dir, "documents").select("doc_id", marked.alias("text")), "doc_id", "text")


#: What stands before and behind the lines of inline_markup, in turn.
MARKS = (("**", "**"), ("`", "` & <b>"), ("~~", "~~ `open"), ("[", "](u?a=1&b)"), ("x *", "* y"), ("_", "_ __b__"), ("", ""))


def inline_markup(spark, sf_dir):
    """Whole texts whose lines are marked in turn, one mark left open."""
    marks = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in MARKS))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.concat(F.element_at(marks, i % len(MARKS) + 1)["a"], x, F.element_at(marks, i % len(MARKS) + 1)["b"]))
    return table(spark, sf_dir, "documents").select("doc_id", X.inline_markup(F.array_join(lines, "\n")).alias("markup"))


def html_blocks(spark, sf_dir):
    return source.html(table(spark, sf_dir, "pages"), "page_id", "html").select("page_id", "pos", "type", "text_level", "text")


def content_list_blocks(spark, sf_dir):
    """Documents written as content lists in JSON, one level of lists in the list, and read again."""
    item = lambda x, i: F.when(i % 5 == 4, F.to_json(F.array(F.named_struct(F.lit("type"), F.lit("image"), F.lit("img_caption"), x)))).otherwise(F.to_json(F.named_struct(F.lit("type"), F.lit("text"), F.lit("text"), x, F.lit("page_idx"), i)))
    raw = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("["), F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), item), ","), F.lit("]")).alias("raw"))
    df = raw.withColumn("blocks", source.from_content(F.col("raw")))
    return df.select("doc_id", F.inline("blocks")).select("doc_id", "pos", "type", "page_idx", F.coalesce("text", F.array_join("captions", ",")).alias("said"))


def span_text(spark, sf_dir):
    """Documents as trees of spans, and their plain text."""
    tree = lambda x, i: F.when(i % 2 == 0, F.to_json(F.named_struct(F.lit("type"), F.lit("paragraph"), F.lit("content"), F.named_struct(F.lit("paragraph_content"), F.array(F.named_struct(F.lit("type"), F.lit("text"), F.lit("content"), x)))))).otherwise(F.to_json(F.named_struct(F.lit("type"), F.lit("list"), F.lit("content"), F.named_struct(F.lit("list_items"), F.array(F.named_struct(F.lit("prefix"), F.lit("-"), F.lit("item_content"), x))))))
    raw = F.concat(F.lit("["), F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), tree), ","), F.lit("]"))
    return table(spark, sf_dir, "documents").select("doc_id", source.span_text(raw).alias("plain"))


def recognised_lines(spark, sf_dir):
    raw = F.to_json(F.array(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.named_struct(F.lit("rec_texts"), F.array(x, x), F.lit("score"), F.lit(0.9)))))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(source.recognised_lines(raw)).alias("pos", "line"))


def reference_tree(spark, sf_dir):
    """Lines as nodes that refer to each other: the body to every fourth, each of those to the three after it."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    node = lambda x, i: F.struct(F.when(i % 5 == 2, "pictures").otherwise("texts").alias("type"), i.alias("idx"), F.when(i % 4 == 0, F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.concat(F.when((i + k) % 5 == 2, "#/pictures/").otherwise("#/texts/"), (i + k).cast("string")))).otherwise(F.expr("cast(array() as array<string>)")).alias("children"), F.when(i % 3 == 1, "formula").otherwise("paragraph").alias("label"), x.alias("text"), F.base64(F.lit(b"png")).alias("image"))
    tops = F.transform(F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: i % 4 == 0), lambda i: F.concat(F.when(i % 5 == 2, "#/pictures/").otherwise("#/texts/"), i.cast("string")))
    body = F.struct(F.lit("body").alias("type"), F.lit(0).alias("idx"), tops.alias("children"), F.lit("body").alias("label"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("image"))
    nodes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_key"), F.inline(F.concat(F.array(body), F.transform(lines, node))))
    return source.reference_tree(nodes).select(F.col("doc_key").alias("doc_id"), "pos", "type", "page_idx", "text")


QUERIES = {f.__name__: f for f in (ingest_documents, separate_content, block_type_counts, content_doc_id, text_recovery, normalize_nested, file_reference, supported_files, url_sources, guarded_images, output_folders, markdown_blocks, inline_markup, html_blocks, content_list_blocks, span_text, recognised_lines, reference_tree)}


def _markup_sql() -> str:
    mark = lambda k: "[" + ", ".join("'" + m[k] + "'" for m in MARKS) + f"][(i - 1) % {len(MARKS)} + 1]"
    styled = "v"
    for pattern, to in X.STYLES:
        styled = f"regexp_replace({styled}, '{pattern}', '{to.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2')}', 'g')"
    return f"""with m as (select doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {mark(0)} || x || {mark(1)}), chr(10)) as x from documents),
        p as (select doc_id, string_split(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '`') as p from m)
        select doc_id, array_to_string(list_transform(p, lambda v, i: case when i % 2 = 0 and i < len(p) then '<code>' || v || '</code>' when i % 2 = 0 then '`' || {styled} else {styled} end), '') as markup from p"""


_URL_PATH = "coalesce(nullif(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), ''), '/')"
HTML_SQL = r"""h as (select page_id, regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->|<!DOCTYPE[^>]*>|<head>.*?</head>|<nav>.*?</nav>|<footer>.*?</footer>|<script>.*?</script>|<style>.*?</style>', '', 'g') as x from pages),
  s as (select page_id, string_split(regexp_replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<(h[1-6])>', chr(1) || '\1' || chr(2), 'g'), '</?(?:p|li|ul|div|article|h[1-6]|body)(?: [^>]*)?>', chr(1), 'g'), chr(1)) as p from h),
  u as (select page_id, unnest(p) as raw, unnest(range(0, len(p))) as k from s),
  t as (select page_id, k, coalesce(try_cast(regexp_extract(raw, '^h([1-6])' || chr(2), 1) as int), 0) as text_level, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(raw, '^h[1-6]' || chr(2), ''), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) as text from u)"""
_PATH = "regexp_replace(regexp_replace(url, '^[a-z]+://', '/srv/'), '[?#].*$', '')"
SQL = {
    "ingest_documents": f"""with {BLOCKS}, d as (select doc_id, string_agg({ITEM_SIGNATURE}, chr(10) order by pos) as sig, coalesce(string_agg(text, chr(10) || chr(10) order by pos) filter (type = 'text' and {strip_sql('text')} <> ''), '') as t, count(*) as n, count(*) filter (type <> 'text') as m from blocks group by doc_id)
        select doc_id, {hash_sql('sig', 'doc-')} as content_id, length(t)::bigint as text_len, n as n_blocks, m as n_multimodal from d""",
    "separate_content": f"with {BLOCKS} select doc_id, coalesce(string_agg(text, chr(10) || chr(10) order by pos) filter (type = 'text' and {strip_sql('text')} <> ''), '') as text_content, count(*) filter (type <> 'text') as n_items from blocks group by doc_id",
    "block_type_counts": f"with {BLOCKS} select doc_id, type, count(*) as n from blocks group by doc_id, type",
    "content_doc_id": f"with {BLOCKS.replace('blocks as (', 'given as (')}, blocks as (select * replace (case when pos % 8 = 0 and type = 'text' then 'note' else type end as type, case when pos % 2 = 0 and not (pos % 8 = 0 and type = 'text') then null else img_path end as img_path) from given) select doc_id, 'doc-' || md5(string_agg({ITEM_SIGNATURE}, chr(10) order by pos)) as content_id from blocks group by doc_id",
    "text_recovery": f"with {BLOCKS} select doc_id, coalesce(string_agg({strip_sql('text')}, chr(10) || chr(10) order by pos) filter (type = 'equation' and {strip_sql('text')} <> ''), '') as text_content from blocks group by doc_id",
    "normalize_nested": "with a as (select doc_id, flatten(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: string_split(x, '. '))) as l from documents) select doc_id, unnest(range(0, len(l)))::int as pos, unnest(l) as item from a",
    "file_reference": f"""with p as (select page_id, url, {_PATH} as path from pages), q as (select *, list_last(string_split(path, '/')) as name, lower(regexp_extract(list_last(string_split(path, '/')), '(\\.[^./]+)$', 1)) as ext from p)
        select page_id, name, substr(path, 6) as relative, ext, case when ext = '.pdf' then 'pdf' when ext in ({", ".join(f"'{x}'" for x in IMAGE)}) then 'image' when ext in ('.doc', '.docx', '.ppt', '.pptx', '.xls', '.xlsx') then 'office' when ext in ('.txt', '.md') then 'text' when ext in ('.html', '.htm', '.xhtml') then 'html' else 'generic' end as kind, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') as is_url from q""",
    "supported_files": f"with f as (select page_id, '/in' || {_URL_PATH} || ['.pdf', '.PNG', '.csv', '.py', '.Md', '.docx', ''][(page_id % 7 + 1)::int] as path from pages) select * from f where lower(regexp_extract(path, '(\\.[^./]+)$', 1)) in ({', '.join(repr(x) for x in sorted({*PDF, *IMAGE, *TEXT}))})",
    "url_sources": "select page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) as scheme, regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1) as host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) as path from pages where regexp_matches(url, '^[a-zA-Z]+://[^/?#]+')",
    "guarded_images": f"""with p as (select page_id, substr({_URL_PATH}, 2) || '.png' as n from pages) select page_id, ['images/', '../', '/data/doc/x/../', '/etc/', './a/./'][(page_id % 5 + 1)::int] || n as given,
        case page_id % 5 when 0 then '/data/doc/images/' || n when 2 then '/data/doc/' || n when 4 then '/data/doc/a/' || n else '' end as img_path, page_id <= 100 as valid from p""",
    "output_folders": f"with p as (select page_id, '/in/' || page_id % 3 || {_URL_PATH} || '.v1.pdf' as p from pages) select page_id, regexp_extract(p, '([^/]*)\\.pdf$', 1) || '_' || left(md5(p), 8) as folder from p",
    "markdown_blocks": f"""with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as x, unnest(range(0, len(string_split(coalesce(text, ''), chr(10)))))::int as pos from documents), m as (select doc_id, pos, repeat('#', pos % 4) || ' ' || x as line from l)
        select doc_id, pos, length(regexp_extract(line, '^(#+)', 1))::int as text_level, {strip_sql("regexp_replace(line, '^#+', '')")} as text from m where {strip_sql('line')} <> ''""",
    "inline_markup": _markup_sql(),
    "html_blocks": f"with {HTML_SQL} select page_id, (row_number() over (partition by page_id order by k) - 1)::int as pos, 'text' as type, text_level, text from t where text <> ''",
    "content_list_blocks": "with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as x, unnest(range(0, len(string_split(coalesce(text, ''), chr(10)))))::int as pos from documents) select doc_id, pos, case when pos % 5 = 4 then 'image' else 'text' end as type, case when pos % 5 = 4 then 0 else pos end as page_idx, case when pos % 5 = 4 then x else x end as said from l",
    "reference_tree": "with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as x, unnest(range(0, len(string_split(coalesce(text, ''), chr(10)))))::int as pos from documents) select doc_id, pos, case when pos % 5 = 2 then 'image' when pos % 3 = 1 then 'equation' else 'text' end as type, (pos // 10)::int as page_idx, x as text from l",
    "span_text": f"""with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as x, unnest(range(0, len(string_split(coalesce(text, ''), chr(10)))))::int as pos from documents)
        select doc_id, coalesce(string_agg(case when pos % 2 = 0 then '' else '- ' end || {strip_sql('x')}, chr(10) || chr(10) order by pos) filter ({strip_sql('x')} <> ''), '') as plain from l group by doc_id""",
    "recognised_lines": f"""with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as x, unnest(range(0, len(string_split(coalesce(text, ''), chr(10)))))::int as pos from documents),
        n as (select doc_id, {strip_sql('x')} as line, row_number() over (partition by doc_id order by pos) as n from l where {strip_sql('x')} <> '') select doc_id, (2 * (n - 1) + k)::int as pos, line from n, (values (0), (1)) t(k)""",
}
