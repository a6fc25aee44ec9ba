"""What queries share: tables, and the SQL of the blocks that stand for parsed documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import blocks as source


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.documents(spark, sf_dir)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.exploded(docs(spark, sf_dir))


#: DuckDB's blocks: doc_id, pos, type, page_idx, line, text, text_level, img_path, captions, table_body.
BLOCKS = """
lines as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10)))))::int as pos from documents),
kinds as (select *, case when pos % 7 = 3 then 'table' when pos % 11 = 5 then 'image' when pos % 13 = 6 then 'equation' else 'text' end as type from lines),
blocks as (select doc_id, pos, type, (pos // 10)::int as page_idx, line, case when type in ('text', 'equation') then line end as text,
  case when type = 'text' and length(line) < 20 then 1 else 0 end as text_level, case when type = 'image' then '/data/img/' || pos || '.png' end as img_path,
  case when type in ('image', 'table') then line end as caption, case when type = 'table' then line end as table_body, case when type = 'equation' then 'latex' end as text_format from kinds)
"""


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def hash_sql(x: str, prefix: str) -> str:
    return f"'{prefix}' || md5({x})"


def truncate_sql(x: str, n: int) -> str:
    """The rule of functions.text.truncate."""
    cut = f"left({x}, {n})"
    last = lambda c: f"(case when instr(reverse({cut}), {c}) = 0 then -1 else length({cut}) - instr(reverse({cut}), {c}) end)"
    return f"""case when length({x}) <= {n} then {x}
      when {last("'.'")} > length({cut}) * 0.8 then left({cut}, ({last("'.'")} + 1)::bigint)
      when {last("chr(10)")} > length({cut}) * 0.8 then left({cut}, ({last("chr(10)")})::bigint) else {cut} || '...' end"""


def template_sql(template: str, of: dict[str, str]) -> str:
    """A template with {names} as a concatenation of SQL expressions; names that of lacks are empty."""
    import string

    parts = []
    for literal, name, _, _ in string.Formatter().parse(template):
        parts += ["'" + literal.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"] * bool(literal) + [f"coalesce({of[name]}, '')" if name in of else "''"] * bool(name)
    return " || ".join(parts)


def prompt_sql(kind: str, **of: str) -> str:
    """The English prompt of a kind, filled from an item's columns."""
    from ..functions.prompts import Prompts

    return template_sql(Prompts().get(kind), {"image_path": "img_path", "captions": "captions", "footnotes": "'None'", **of})


def answers(df: DataFrame) -> DataFrame:
    """A model's answers for tests, made from whole text blocks, quoted, as JSON: fenced, bare, with a thought before, with a
    comma too many, cut short within a string, cut short behind one; or plain text after a thought."""
    told = F.concat(F.lit('"'), F.col("text"), F.lit('" \\ said'))
    body = F.to_json(F.struct(told.alias("detailed_description"), F.struct(F.concat(F.lit("E"), F.col("pos")).alias("entity_name"), F.lit("thing").alias("entity_type"), F.concat(F.lit("s"), F.col("doc_id")).alias("summary")).alias("entity_info")))
    kind = F.col("pos") % 7
    named = F.instr(body, ',"entity_info":')
    out = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(kind == 1, body)
        .when(kind == 2, F.concat(F.lit("<think>a {b}\n</think> "), body))
        .when(kind == 3, F.concat(F.left(body, F.length(body) - 2), F.lit(",}}")))
        .when(kind == 4, F.concat(F.lit("  <THINKING>x</THINKING>"), F.col("text")))
        .when(kind == 5, F.left(body, (named - 2 + 24) / 2))
        .otherwise(F.concat(F.left(body, F.length(body) - F.length(F.substring_index(body, ',"entity_type"', -1)) - 14), F.lit(',"entity_ty')))
    )
    return df.where("type = 'text'").withColumn("answer", out)


def answers_sql() -> str:
    """DuckDB's answers: doc_id, pos, text, told, j (told as JSON), answer."""
    start = "'{\"detailed_description\":' || j"
    name = f"""{start} || ',"entity_info":{{"entity_name":"E' || pos || '"'"""
    whole = f"""{name} || ',"entity_type":"thing","summary":"s' || doc_id || '"'"""
    return f"""
said as (select doc_id, pos, text, '"' || text || '" \\ said' as told, to_json('"' || text || '" \\ said')::varchar as j from blocks where type = 'text'),
answers as (select *, case pos % 7 when 0 then '```json' || chr(10) || {whole} || '}}}}' || chr(10) || '```' when 1 then {whole} || '}}}}' when 2 then '<think>a {{b}}' || chr(10) || '</think> ' || {whole} || '}}}}'
  when 3 then {whole} || ',}}}}' when 4 then '  <THINKING>x</THINKING>' || text when 5 then left({start}, ((24 + length(j) - 1 + 24) // 2)::bigint) else {name} || ',"entity_ty' end as answer from said)
"""


ANSWERS = answers_sql()
