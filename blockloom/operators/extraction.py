"""Entities and relations of chunks: a prompt, the records that a model writes, and a second question for what it missed.

A record is a line or what stands between RECORD marks: `entity<|>name<|>type<|>description` or
`relation<|>source<|>target<|>description<|>keywords<|>weight`, in brackets and quotes or not. Models break this: marks lose
a stroke, brackets or quotes stay open, fields are missing or too many, numbers are words, an answer ends within a
record. What can still be told is kept: names and kinds must be there, a missing description is empty, a missing weight 1.
Parsing is one pass of the JVM's expressions; only the model is Python."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import models
from ..functions.text import hash_id, strip, strip_thinking
from ..shared import durable

FIELD, RECORD, END = "<|>", "##", "<|COMPLETE|>"
TYPES = ("person", "organisation", "place", "event", "concept", "method", "data", "thing")
#: Longest names that are taken; what is longer is a sentence that lost its marks.
NAME_CHARS = 256
ASK = (
    "Find the entities in the text and how they are related.\n"
    "Write one line for each entity: entity{field}name{field}type{field}description, the type one of {types}.\n"
    "Write one line for each related pair: relation{field}source{field}target{field}description{field}keywords{field}weight, "
    "with keywords separated by commas and a weight from 0 to 10.\n"
    "Write {end} when you are done.\n\nText:\n"
)
AGAIN = "\n\nSome entities and relations of the text were missed. Write only those that are still missing, in the same form, and then {end}."


@dataclass(frozen=True)
class Extraction:
    """Entities: chunk_id, entity_name, entity_type, description, source_id. Relations: chunk_id, src_id, tgt_id, description, keywords, weight, source_id."""

    entities: DataFrame
    relations: DataFrame


def asked(content: Column, types: tuple[str, ...] = TYPES) -> Column:
    return F.concat(F.lit(ASK.format(field=FIELD, types=", ".join(types), end=END)), content)


def records(answer: Column) -> Column:
    """The fields of each record of an answer, without brackets, quotes and the space around them."""
    said = F.substring_index(strip_thinking(F.coalesce(answer, F.lit(""))), END, 1)
    lines = F.filter(F.transform(F.split(said, rf"\n|{RECORD}"), strip), lambda x: x != "")
    # a mark may have lost a stroke or have one too many
    split = lambda x: F.split(F.regexp_replace(x, r"^[\s\-*(]++|[\s)]++$", ""), r"<\|{1,3}>|<\|(?!>)|(?<!<)\|>")
    return F.transform(lines, lambda x: F.transform(split(x), lambda f: F.regexp_replace(f, r"""^[\s"'“”]++|(?<![\s"'“”])[\s"'“”]++$""", "")))


def _field(r: Column, k: int) -> Column:
    return F.coalesce(F.get(r, F.lit(k)), F.lit(""))


def _named(x: Column) -> Column:
    return (x != "") & (F.length(x) <= NAME_CHARS)


def parsed_entities(found: Column) -> Column:
    """Of records(): structs of name, type, description. A description that holds marks is put together again."""
    kind = lambda r: F.lower(_field(r, 0)).rlike("^entit")
    kept = F.filter(found, lambda r: kind(r) & _named(_field(r, 1)))
    return F.transform(
        kept,
        lambda r: F.struct(
            _field(r, 1).alias("name"),
            F.coalesce(F.nullif(F.lower(_field(r, 2)), F.lit("")), F.lit("unknown")).alias("type"),
            F.array_join(F.slice(r, 4, F.greatest(F.size(r) - 3, F.lit(0))), " ").alias("description"),
        ),
    )


def parsed_relations(found: Column) -> Column:
    """Of records(): structs of source, target, description, keywords, weight; none of a name to itself."""
    kind = lambda r: F.lower(_field(r, 0)).rlike("^relation")
    kept = F.filter(found, lambda r: kind(r) & _named(_field(r, 1)) & _named(_field(r, 2)) & (_field(r, 1) != _field(r, 2)))
    return F.transform(
        kept,
        lambda r: F.struct(
            _field(r, 1).alias("source"),
            _field(r, 2).alias("target"),
            _field(r, 3).alias("description"),
            F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.lower(_field(r, 4)), "[,;]"), strip), lambda w: w != ""))), ",").alias("keywords"),
            _number(_field(r, 5)).alias("weight"),
        ),
    )


def _number(x: Column) -> Column:
    """A plain number from 0 to 10, else 1."""
    n = F.when(x.rlike(r"^[0-9]{1,2}(\.[0-9]+)?$"), x.try_cast("double"))
    return F.coalesce(F.when(n.between(0, 10), n), F.lit(1.0))


def answers(chunks: DataFrame, load: Callable, gleanings: int = 1, types: tuple[str, ...] = TYPES) -> DataFrame:
    """chunk_id, turn, answer, error: the first answer, and as many more as are asked for what was missed. Each chunk takes
    1 + gleanings calls; a turn's answers are written to the shared folder before the next turn's question quotes them."""
    prompt = asked(F.col("content"), types)
    said = chunks.select("chunk_id", prompt.alias("_p"))
    out = None
    for turn in range(gleanings + 1):
        got = durable(said.withColumn("_a", models.answers(F.col("_p"), load)))
        row = got.select("chunk_id", F.lit(turn).alias("turn"), F.col("_a.value").alias("answer"), F.col("_a.error").alias("error"))
        out = row if out is None else out.unionByName(row)
        again = F.concat("_p", F.lit("\n\n"), F.col("_a.value"), F.lit(AGAIN.format(end=END)))
        said = got.where("_a.value is not null").select("chunk_id", again.alias("_p"))
    return out


def extracted(said: DataFrame) -> Extraction:
    """What answers() say. Of a chunk's records of one name (or one pair in one direction) the longest description stays, of
    equal ones the first turn's, then the first by alphabet; of weights the highest; a chunk's own records only meet."""
    rows = said.where("answer is not null").select("chunk_id", "turn", records(F.col("answer")).alias("r"))
    e = rows.select("chunk_id", "turn", F.inline(parsed_entities(F.col("r"))))
    order = lambda last: F.struct((-F.length("description")).alias("l"), "turn", "description", last)
    entities = e.groupBy("chunk_id", F.col("name").alias("entity_name")).agg(F.min_by(F.struct("type", "description"), order("type")).alias("s"))
    entities = entities.select("chunk_id", "entity_name", F.col("s.type").alias("entity_type"), F.col("s.description").alias("description"), F.col("chunk_id").alias("source_id"))
    r = rows.select("chunk_id", "turn", F.inline(parsed_relations(F.col("r"))))
    relations = r.groupBy("chunk_id", F.col("source").alias("src_id"), F.col("target").alias("tgt_id")).agg(F.min_by(F.struct("description", "keywords"), order("keywords")).alias("s"), F.max("weight").alias("weight"))
    relations = relations.select("chunk_id", "src_id", "tgt_id", F.col("s.description").alias("description"), F.col("s.keywords").alias("keywords"), "weight", F.col("chunk_id").alias("source_id"))
    return Extraction(entities, relations)


def extractor(load: Callable, gleanings: int = 1, types: tuple[str, ...] = TYPES) -> Callable[[DataFrame], Extraction]:
    """What ingest() takes: from chunks (chunk_id, content) to entities and relations."""
    return lambda chunks: extracted(answers(chunks, load, gleanings, types))


def with_ends(found: Extraction) -> DataFrame:
    """The entities, and a bare one for each end of a relation that has none in its chunk."""
    ends = found.relations.select("chunk_id", F.explode(F.array("src_id", "tgt_id")).alias("entity_name"), "source_id").distinct()
    missing = ends.join(found.entities.select("chunk_id", "entity_name"), ["chunk_id", "entity_name"], "left_anti")
    return found.entities.unionByName(missing.select("chunk_id", "entity_name", F.lit("unknown").alias("entity_type"), F.lit("").alias("description"), "source_id"))


def relation_rows(relations: DataFrame) -> DataFrame:
    """Relations as the vector store keeps them: an id of both names in order, and the text that is embedded."""
    a, b = F.least("src_id", "tgt_id"), F.greatest("src_id", "tgt_id")
    return relations.select(
        hash_id(F.concat(a, F.lit("\t"), b), "rel-").alias("relation_id"), "src_id", "tgt_id", "description", "keywords", "weight", "source_id",
        F.concat_ws("\n", F.concat_ws("\t", "keywords", "src_id", "tgt_id"), "description").alias("content"),
    )
