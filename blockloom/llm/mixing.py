"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

Each source has a target weight; its mean repetition rate is target share x all rows / its own rows. A row's number of
copies inverts the Poisson distribution of that mean at a uniform value hashed from (seed, row), so it is the same in
every run and whatever the partitioning. Rates above PART are split into equal parts, each with a hash of its own (a
sum of Poisson counts is one), which keeps the tables of the distribution short. Copies are then dealt over all
partitions by a hash and sorted by it: a global shuffle that reruns alike.

Targets: a dict source -> weight (sources not in it get none and leave), or by default weights n ** ALPHA, which
flatten the sources' natural sizes. Nulls: a null source is a source of its own (None in the dict); null ids and
texts hash as empty. Rows that agree in id and text draw the same number. Empty table: empty result. Columns of docs
named like the added ones (copy, copies, rate, shuffle_key) are replaced; any others, whatever their names, are returned
as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, durable, packed, row_digest, spread_join, table

SEED, ALPHA, PART = 42, 0.5, 16.0
#: Sources whose rates are broadcast at most; beyond, rows of the largest sources meet their rates in place, the others by shuffle.
BROADCAST_SOURCES = 10_000
TERMS = 96  # of a distribution of mean PART at most; what is beyond has a chance below 2**-52
ADDED = ("copy", "copies", "rate", "shuffle_key")
SQL_NAME = "op7_mixing"


def _hash(seed: str, *parts: Column) -> Column:
    """52 hashed bits."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *parts)), 1, 13), 16, 10).cast("long")


def rates(docs: DataFrame, source: str, targets: dict[str | None, float] | None, alpha: float) -> DataFrame:
    """source, rate, n, parts, cdf of a part: one row for each source of docs that has a weight."""
    sizes = durable(docs.groupBy(col(source).alias("source")).agg(F.count("*").alias("n")))
    if targets is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(alpha)))
    else:
        named = [x for k, v in targets.items() if k is not None for x in (F.lit(k), F.lit(float(v)))]
        known = F.element_at(F.create_map(*named), F.col("source").cast("string")) if named else F.lit(None).cast("double")
        weight = F.coalesce(F.when(F.col("source").isNull(), F.lit(float(targets.get(None, 0.0)))).otherwise(known), F.lit(0.0))
    sizes = sizes.withColumn("w", weight)
    # one row of two sums; rows of sources without a weight count towards the total that is to be reached
    sums = sizes.agg(F.sum("w").alias("w"), F.sum("n").alias("n")).first()
    total, rows = sums["w"] or 1.0, sums["n"] or 0
    out = sizes.where("w > 0").select("source", (F.col("w") / F.lit(float(total)) * F.lit(float(rows)) / F.col("n")).alias("rate"), "n")
    out = out.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")).withColumn("mean", F.col("rate") / F.col("parts"))
    terms = F.expr(f"""aggregate(sequence(1, {TERMS}), struct(array(exp(-mean)) as cdf, exp(-mean) as term),
        (a, j) -> struct(concat(a.cdf, array(element_at(a.cdf, -1) + a.term * mean / j)) as cdf, a.term * mean / j as term), a -> a.cdf)""")
    return out.withColumn("cdf", terms).drop("mean")


def mix(docs: DataFrame, targets: dict[str | None, float] | None = None, source: str = "source", doc_id: str = "doc_id", text: str = "text", seed: int = SEED, alpha: float = ALPHA) -> DataFrame:
    """docs with each row repeated, copies numbered from 1, in a global pseudo-random order."""
    rest = docs.drop(*(c for c in docs.columns if c.lower() in ADDED))
    rows = docs.select(packed(rest), col(source).alias("of"), row_digest(doc_id, text).alias("id"))
    by = rates(docs, source, targets, alpha)
    if by.count() <= BROADCAST_SOURCES:
        met = rows.join(F.broadcast(by), F.col("of").eqNullSafe(F.col("source")))
    else:
        key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias("key")
        met = spread_join(rows.select("*", key("of")), by.select("*", key("source")), ["key"], rows.count())
    # each part's hash once, then its place in the distribution
    uniform = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda p: _hash(str(seed), F.col("id"), p.cast("string")) / F.lit(2.0**52))
    draws = F.aggregate(uniform, F.lit(0), lambda a, u: a + F.size(F.filter(F.col("cdf"), lambda c: c <= u)))
    met = met.withColumn("copies", draws).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    met = met.withColumn("shuffle_key", _hash(f"{seed}:order", F.col("id"), F.col("copy").cast("string")))
    return met.select("row.*", "copy", "copies", F.round("rate", 9).alias("rate"), "shuffle_key").repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def sql(docs: str = "documents", seed: int = SEED, alpha: float = ALPHA) -> str:
    return f"""
with n as (select source, count(*) as n, pow(count(*)::double, {alpha}) as w from {docs} group by source),
r as (select source, w / (select sum(w) from n) * (select sum(n) from n) / n as rate from n),
p as (select *, greatest(1, ceil(rate / {PART}))::int as parts, rate / greatest(1, ceil(rate / {PART}))::int as mean from r),
cdf as (select source, list(f order by j) as cdf from (select source, j, sum(exp(-mean + j * ln(mean) - lgamma(j + 1))) over (partition by source order by j) as f from p, range(0, {TERMS + 1}) t(j)) group by source),
d as (select *, md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as id from {docs}),
m as (select d.*, p.rate, list_sum(list_transform(range(1, p.parts + 1), lambda q: len(list_filter(cdf.cdf, lambda c: c <= ('0x' || substr(md5('{seed}:' || d.id || ':' || q), 1, 13))::bigint / 4503599627370496.0))))::int as copies
  from d join p on d.source is not distinct from p.source join cdf on cdf.source is not distinct from p.source)
select doc_id, text, lang, source, n_chars, c::int as copy, copies, round(rate, 9) as rate, ('0x' || substr(md5('{seed}:order:' || id || ':' || c), 1, 13))::bigint as shuffle_key
from m, lateral (select unnest(range(1, copies + 1)) as c)
"""
