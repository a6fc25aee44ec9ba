"""Sharding by extendible hashing, in DataFrame operations only.

A row's hash is 60 bits of an md5 over its id and text. The directory starts with one bucket; a bucket above the byte
limit, and only such a bucket, splits on the next bit. Sizes are gathered in rounds: each aggregates the rows of buckets
that are still too large, with map-side partial sums, to cells of some more bits and finds all splits among them at once.
The first round takes LEVEL_BITS bits, each later one as many as its buckets' mean size asks for and one more; so the
cells stay few for each bucket, and outliers go on to the next round. Hashes and sizes are computed once (16 bytes a
row); the rounds read only these. Directories of up to BROADCAST_CELLS cells are broadcast to the rows; with more, hashes
meet their shards by shuffle, and rows meet those once.

Nulls: a null id or text hashes and weighs like an empty string. Empty table: no shard. Rows that agree in id and text
have the same hash and no bit parts them: if together they exceed the limit, they are numbered and paged over several
shards ("<bits>#<page>"). One row above the limit is a shard of its own, marked oversize. Columns of docs named like
the added ones (shard, shard_depth, shard_bytes, shard_rows, oversize) are replaced; any others, whatever their names,
are returned as they are.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, discard, durable, packed, row_digest, spread_join, table

HASH_BITS, LEVEL_BITS = 60, 12
LIMIT_BYTES = 32 << 20
#: Of the registered query: low enough that small tables have many shards, and buckets that only paging splits.
QUERY_BYTES = 64 << 10
#: Directory cells of later rounds that are broadcast at most; beyond, the join shuffles.
BROADCAST_CELLS = 100_000
ADDED = ("shard", "shard_depth", "shard_bytes", "shard_rows", "oversize")
SQL_NAME = "op1_sharding"


def _prefix(bits: int) -> Column:
    return F.shiftright(F.col("h"), HASH_BITS - bits)


def _level(rows: DataFrame, base: int, deep: int, limit: int) -> DataFrame:
    """The nodes of the directory between base and deep bits, each with its own and its parent's size."""
    cells = rows.groupBy(_prefix(deep).alias("cell")).agg(F.sum("b").alias("b"), F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
    nodes = (
        cells.withColumn("depth", F.explode(F.sequence(F.lit(base if base == 0 else base + 1), F.lit(deep))))
        .groupBy("depth", F.expr(f"shiftright(cell, {deep} - depth)").alias("prefix"))
        .agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )
    parent = W.partitionBy("depth", F.shiftright("prefix", 1))
    whole = (F.sum("b").over(parent) <= limit) | (F.min("lo").over(parent) == F.max("hi").over(parent))
    fits = (F.col("b") <= limit) | (F.col("lo") == F.col("hi"))
    return nodes.select("*", fits.alias("fits"), F.when(F.col("depth") == 0, F.lit(False)).otherwise(whole).alias("parent_fits"))


def directory(rows: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """For each round, its depth and its nodes; leaves are those that fit while their parents don't."""
    levels: list[tuple[int, DataFrame]] = []
    base, bits, given = 0, LEVEL_BITS, rows
    while base < HASH_BITS:
        deep = min(HASH_BITS, base + bits)
        nodes = durable(_level(rows, base, deep, limit))
        levels.append((deep, nodes))
        large = nodes.where(~F.col("fits") & (F.col("depth") == deep)).select(F.col("prefix").alias("open"), "b")
        mean, n = large.agg(F.avg("b"), F.count("*")).first()
        if n:
            opened = F.broadcast(large.select("open")) if n <= BROADCAST_CELLS else large.select("open")
            left = durable(rows.join(opened, _prefix(deep) == F.col("open"), "left_semi"))
        if rows is not given:
            discard(rows)
        if not n:
            break
        rows = left
        base, bits = deep, min(LEVEL_BITS, max(1, math.ceil(math.log2(max(1.0, float(mean) / limit))) + 1))
    return levels


def _leaves(deep: int, nodes: DataFrame, k: int) -> DataFrame:
    """Every cell of a round that lies under a leaf, with the leaf."""
    span = F.expr(f"shiftleft(1L, {deep} - depth)")
    leaves = nodes.where("fits and not parent_fits")
    cells = leaves.select(F.explode(F.sequence(F.lit(0).cast("long"), span - 1)).alias("i"), span.alias("w"), F.struct("depth", "prefix", "b", "n").alias(f"leaf{k}"))
    return cells.select((F.col(f"leaf{k}.prefix") * F.col("w") + F.col("i")).alias(f"cell{k}"), f"leaf{k}")


def shard(docs: DataFrame, limit: int = LIMIT_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the shard of each row, clustered by shard."""
    rest = docs.drop(*(c for c in docs.columns if c.lower() in ADDED))
    rows = docs.select(packed(rest), F.conv(F.substring(row_digest(doc_id, text), 1, HASH_BITS // 4), 16, 10).cast("long").alias("h"), F.coalesce(F.octet_length(col(text)), F.lit(0)).cast("long").alias("b"))
    slim = durable(rows.select("h", "b"))
    levels = directory(slim, limit)
    leaves = [(deep, _leaves(deep, nodes, k)) for k, (deep, nodes) in enumerate(levels)]
    few = all(deep <= LEVEL_BITS or cells.count() <= BROADCAST_CELLS for deep, cells in leaves)
    out = rows if few else slim.groupBy("h").agg(F.count("*").alias("same"))
    for k, (deep, cells) in enumerate(leaves):
        out = out.join(F.broadcast(cells) if few else cells, _prefix(deep) == F.col(f"cell{k}"), "left").drop(f"cell{k}")
    out = out.withColumn("leaf", F.coalesce(*(F.col(f"leaf{k}") for k in range(len(leaves)))))
    out = out if few else spread_join(rows, out.select("h", "leaf", "same"), ["h"], slim.count(), "same")
    bits = F.when(F.col("leaf.depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(leaf.prefix), leaf.depth, '0')"))
    done = out.select("row", F.concat(F.lit("b"), bits).alias("shard"), F.col("leaf.depth").alias("shard_depth"), F.col("leaf.b").alias("shard_bytes"), F.col("leaf.n").alias("shard_rows"), (F.col("leaf.b") > limit).alias("oversize"), "h", "b")
    copies = reduce(DataFrame.unionByName, [x.where("fits and not parent_fits") for _, x in levels]).where((F.col("b") > limit) & (F.col("n") > 1))
    if not copies.isEmpty():
        stuck = F.col("oversize") & (F.col("shard_rows") > 1)
        done = done.where(~stuck).unionByName(_paged(durable(done.where(stuck).withColumn("at", F.monotonically_increasing_id())), limit))
    return done.select("row.*", *ADDED).hint("rebalance", "shard")


def _paged(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of one hash each, numbered without bringing a hash to one task: counts per input partition, then offsets."""
    rows = rows.withColumn("part", F.shiftright("at", 33))
    sizes = rows.groupBy("h", "part").agg(F.count("*").alias("c"))
    before = W.partitionBy("h").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("h", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("off"))
    rows = rows.join(offsets, ["h", "part"])
    number = F.row_number().over(W.partitionBy("h", "part").orderBy("at")) - 1 + F.col("off")
    per = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("b"), F.lit(1)))).cast("long")
    page = F.floor(number / per).cast("long")
    here = F.least(per, F.col("shard_rows") - page * per)
    paged = rows.select("*", page.alias("page"), here.alias("here")).withColumns({"shard": F.concat("shard", F.lit("#"), F.col("page")), "shard_bytes": F.col("here") * F.col("b"), "shard_rows": F.col("here"), "oversize": F.col("b") > limit})
    return paged.drop("part", "off", "at", "page", "here")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), QUERY_BYTES)


def sql(limit: int = QUERY_BYTES, docs: str = "documents") -> str:
    """DuckDB's equivalent: the least depth at which a row's bucket fits; rows that agree in id and text, paged if together they don't."""
    return f"""
with recursive d as (select *, ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))), 1, 15))::bigint as h, strlen(coalesce(text, ''))::bigint as sz from {docs}),
nodes as (select k::int as depth, h >> ({HASH_BITS} - k) as prefix, sum(sz)::bigint as b, count(*) as n, min(h) = max(h) as one from d, range(0, {HASH_BITS + 1}) r(k) group by all),
fit as (select d.h, min(nodes.depth) as depth from (select distinct h from d) d, nodes where nodes.prefix = d.h >> ({HASH_BITS} - nodes.depth) and (nodes.b <= {limit} or nodes.one) group by all),
placed as (select d.*, fit.depth, nodes.b, nodes.n, 'b' || case when fit.depth = 0 then '' else right(lpad(bin(nodes.prefix), 64, '0'), fit.depth) end as shard, nodes.b > {limit} and nodes.n > 1 as stuck,
    greatest(1, {limit} // greatest(d.sz, 1)) as per, (row_number() over (partition by d.h) - 1) // greatest(1, {limit} // greatest(d.sz, 1)) as page
  from d join fit using (h) join nodes on nodes.depth = fit.depth and nodes.prefix = d.h >> ({HASH_BITS} - fit.depth))
select doc_id, text, lang, source, n_chars, case when stuck then shard || '#' || page else shard end as shard, depth as shard_depth,
  case when stuck then least(per, n - page * per) * sz else b end as shard_bytes, case when stuck then least(per, n - page * per) else n end as shard_rows, case when stuck then sz else b end > {limit} as oversize
from placed
"""
