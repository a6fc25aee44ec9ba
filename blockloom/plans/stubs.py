"""Deterministic stand-ins for models and extractors, for queries and tests."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import models
from ..operators import extraction


def first_words(found: DataFrame) -> DataFrame:
    """An extractor without a model: the capitalised words of a chunk."""
    words = F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?:^|[^\p{L}])(\p{Lu}\p{L}{3,})"), 1))
    return found.select("chunk_id", F.explode(words).alias("entity_name")).select("chunk_id", "entity_name", F.lit("word").alias("entity_type"), F.lit("a word").alias("description"), F.col("chunk_id").alias("source_id"))


def md5(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def record_writer():
    """A model that writes records of a text's sentences as extraction asks for, in every way that models break them. The
    first answer leaves out each third sentence; a second question gets these. Each sentence is tied to the next."""

    def entity(k: int, name: str, kind: str, said: str) -> str:
        f = extraction.FIELD
        return (
            f"entity{f}{name}{f}{kind}{f}{said}",
            f'("entity"{f}"{name}"{f}"{kind}"{f}"{said}")',
            f"entity<||>{name}<|{kind}|>{said}",
            f"entity{f}{name}{f}{kind}",
            f"entity{f}{name}{f}{kind}{f}{said}{f}more{f}",
            f"entity{f}{f}{kind}{f}{said}",
            f"  - entity{f} {name} {f}{kind}{f}{said}##",
            f"(ENTITY{f}'{name}'{f}{kind.upper()}{f}{said}",
        )[k % 8]

    def relation(k: int, a: str, b: str) -> str:
        f, weight = extraction.FIELD, "strong" if k % 5 == 4 else str(k % 10)
        return (
            f"relation{f}{a}{f}{b}{f}{a} before {b}{f}next, Follows{f}{weight}",
            f'("relationship"{f}{a}{f}{b}{f}{a} before {b}{f}next;next,follows{f}"{weight}")',
            f"relation{f}{a}{f}{b}",
            f"relation{f}{a}{f}{a}{f}itself{f}x{f}3",
        )[k % 4]

    def one(prompt: str) -> str:
        text = prompt[prompt.index("Text:\n") + 6 :]
        again = extraction.AGAIN.format(end=extraction.END)
        second = text.endswith(again)
        if second:
            # the text is what the question was before the first answer
            text = text[: text.index("\n\n<records>\n")]
        words = [" ".join(re.findall(r"\w+", s)) for s in re.split(r"[.\n]", text)]
        said = [(k, w) for k, w in enumerate(w for w in words if w)]
        names = [md5(w)[:8] for _, w in said]
        lines = [entity(k, names[k], "odd" if k % 2 else "even", w) for k, w in said if (k % 3 == 2) == second]
        if not second:
            lines += [relation(k, names[k], names[k + 1]) for k, _ in said[:-1]]
        cut = len(said) % 4 == 3
        body = "\n".join(lines)
        return ("" if second else "\n\n<records>\n") + body + (f"\nrelation{extraction.FIELD}{names[0]}" if cut else f"\n{extraction.END}\nentity<|>after<|>the<|>end")

    return lambda prompts: [one(p) for p in prompts]


def short_sums():
    """A model that answers with the first eight digits of the question's md5."""
    return lambda prompts: ["sum " + md5(p)[:8] for p in prompts]


def record_or_entity():
    """The one of the stubs above that a question is for: records of a text, a sum of descriptions, or an item's JSON."""
    records, sums, items = record_writer(), short_sums(), models.stub_text()

    def one(prompt: str) -> str:
        model = records if prompt.startswith(extraction.ASK[:20]) else sums if prompt.startswith("Merge these") else items
        return model([prompt])[0]

    return lambda prompts: [one(p) for p in prompts]


def vectors_of_16():
    return models.stub_vectors(16)()


def fair_judge():
    """A judge that finds every answer right."""
    return lambda prompts: ['{"accuracy": 1, "relevance": 0.5}' for _ in prompts]
