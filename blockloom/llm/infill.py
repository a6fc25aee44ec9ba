"""Fill-in-the-middle: a text is cut into units, two cuts part it, and its parts are put in another order behind markers.

Units come from lookaround splitting. A grammar says which characters a unit is made of; it is translated to a regular
expression of zero width that matches between two characters by the classes of the one before and the one after, and
Spark's split at these places keeps every character. Nothing leaves the JVM, nothing is shuffled.

Which cuts and which form a row gets follows from sha256 of the seed and its id: two cuts among the unit boundaries, the
outer ones included, so that prefix, middle or suffix may be empty. Forms: plain (the text as it is), psm
(prefix, suffix, middle) and spm (suffix, prefix, middle).

Nulls are empty texts; a null id hashes as an empty string. An empty text has no units (split would give one empty one)
and stays plain, as does a text that holds a marker, so that restored() is exact. Every input row gives one row; rows that
agree in id are cut by the same numbers; an empty table gives none. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, table

SEED, RATE, SPM = 7, 100, 50  # of a hundred rows, those that are transformed; of these, those in the form spm
MARKERS = {"P": "<P>", "S": "<S>", "M": "<M>"}
_ANY = r"(?=[\s\S])"


@dataclass(frozen=True)
class Closed:
    """Units that end with a character of a class, or with the text: `[^c]*[c]|[^c]+`."""

    end: str

    def boundary(self) -> str:
        return f"(?<=[{self.end}]){_ANY}"

    def pattern(self) -> str:
        return f"[^{self.end}]*[{self.end}]|[^{self.end}]+"


@dataclass(frozen=True)
class Trailed:
    """Units of other characters with the run of a class that follows them; a leading run is a unit: `[^c]+[c]*|[c]+`."""

    tail: str

    def boundary(self) -> str:
        return f"(?<=[{self.tail}])(?=[^{self.tail}])"

    def pattern(self) -> str:
        return f"[^{self.tail}]+[{self.tail}]*|[{self.tail}]+"


@dataclass(frozen=True)
class Runs:
    """Longest runs of each of some disjoint classes; each character of none of them is a unit: `[a]+|[b]+|[^ab]`."""

    classes: tuple[str, ...] = ()

    def boundary(self) -> str:
        turns = [f"(?<=[{c}])(?=[^{c}])" for c in self.classes]
        return "|".join([*turns, f"(?<=[^{''.join(self.classes)}]){_ANY}" if self.classes else r"(?<=[\s\S])" + _ANY])

    def pattern(self) -> str:
        return "|".join([*(f"[{c}]+" for c in self.classes), f"[^{''.join(self.classes)}]" if self.classes else r"[\s\S]"])


Grammar = Closed | Trailed | Runs
#: Classes are written so that Java's and Python's expressions mean the same by them.
GRAMMARS: dict[str, Grammar] = {
    "line": Closed(r"\n"),
    "word": Trailed(r" \t\r\n"),
    "token": Runs(("A-Za-z0-9_", r" \t\r\n")),
    "character": Runs(),
}


def units(text: Column, grammar: Grammar = GRAMMARS["line"]) -> Column:
    """The text's units as an array; none of an empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, grammar.boundary(), -1))


def transform(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", grammar: Grammar = GRAMMARS["line"], seed: int = SEED, rate: int = RATE, spm: int = SPM, markers: dict[str, str] = MARKERS
) -> DataFrame:
    """doc_id, n (units), form, prefix, middle, suffix (null if plain) and output for every row of docs."""
    slim = docs.select(col(doc_id).alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    cut = slim.select("*", units(F.col("text"), grammar).alias("units"), digest.alias("digest"))
    h = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    cut = cut.withColumn("n", F.size("units").cast("long"))
    marked = F.lit(False)
    for m in markers.values():
        marked = marked | F.contains("text", F.lit(m))
    form = F.when((F.col("text") == "") | marked | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    a, b = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    cut = cut.select("doc_id", "text", "units", "n", form.alias("form"), F.least(a, b).cast("int").alias("lo"), F.greatest(a, b).cast("int").alias("hi"))
    part = lambda start, size: F.when(F.col("form") != "plain", F.array_join(F.slice("units", start, size), ""))
    lo, hi = F.col("lo"), F.col("hi")
    parted = cut.select("doc_id", "n", "form", "text", part(1, lo).alias("prefix"), part(lo + 1, hi - lo).alias("middle"), part(hi + 1, F.col("n").cast("int") - hi).alias("suffix"))
    p, s, m = (F.concat(F.lit(markers[k]), F.col(name)) for k, name in (("P", "prefix"), ("S", "suffix"), ("M", "middle")))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, s, m)).otherwise(F.concat(s, p, m))
    return parted.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column, markers: dict[str, str] = MARKERS) -> Column:
    """The text from what transform() made of it. Markers can't arise where parts meet: each starts with a character of its own."""
    parts = F.split(output, "|".join(r"\Q" + m + r"\E" for m in markers.values()), -1)
    first, second, middle = (parts[k] for k in (1, 2, 3))  # what is before the first marker is empty
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(table(spark, sf_dir, "documents"))
    chars = [F.length(k).cast("long").alias(f"{k}_chars") for k in ("prefix", "middle")]
    return out.select("doc_id", "n", "form", *chars, F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def sql(docs: str = "documents") -> str:
    h = ", ".join(f"('0x' || substr(digest, {8 * k + 1}, 8))::bigint as h{k + 1}" for k in range(4))
    return rf"""
with d as (select doc_id, coalesce(text, '') as t, sha256('{SEED}:' || coalesce(doc_id::varchar, '')) as digest from {docs}),
u as (select doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') as us, {h} from d),
c as (select *, len(us) as n, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= {RATE} then 'plain' when h4 % 100 < {SPM} then 'spm' else 'psm' end as form,
  least(h1 % (len(us) + 1), h2 % (len(us) + 1)) as lo, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) as hi from u),
p as (select *, coalesce(array_to_string(us[1:lo], ''), '') as pre, coalesce(array_to_string(us[lo + 1:hi], ''), '') as mid, coalesce(array_to_string(us[hi + 1:n], ''), '') as suf from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(t) as restored_sha256
from p
"""
