"""A dataset's Merkle manifest: a tree over each group's rows, a tree over the groups, and a proof for every row.

A row's leaf is the sha256 of some of its columns, each with its length before it. Leaves (a few bytes a row, whatever the
texts' sizes) are written once, sorted by range over (group, order, leaf, place) and written again, so that partitions are
fixed from then on. Counts of each partition's groups give offsets: only the first and last group of a partition can reach
beyond it, so at most two rows a partition (spans) say where its rows stand in their groups; they are broadcast, as their
number is bounded by that of the partitions. Each task then builds all subtrees that lie wholly within its rows. What is
left are ragged nodes at the partitions' borders, at most FANOUT - 1 a level on either side: they are shuffled by coordinate
(group, level, number of the parent) to finish the upper levels, one level after the other. No group is brought to one
task, be it a third of all rows. The roots of groups are the leaves of a tree of the same make. In a last pass every
partition gets the runs of siblings that it lacks, and its rows' proofs are folded to the root.

Rows that agree in group and order are sorted by leaf; repeated rows are leaves of their own. Null groups come first, as
do null orders; a null column is hashed as "-". Empty table: no tree and no rows. Columns that aren't named aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, durable, session_of, spread_join, table

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a sorted partition at most, as aimed at (a task holds their digests), and at least, where there are more partitions.
PART_ROWS, LEAST_ROWS = 1 << 18, 1 << 10
NODES = "grp string, level int, at long, digest string, depth int"
PATH = "array<struct<place:int,others:array<string>>>"
Crossing = dict[tuple[int, str], tuple[int, int]]
Proof = list[tuple[int, list[str]]]


def leaf_of(values: list[Column]) -> Column:
    """sha256 of the values, each as its UTF-8 length, a colon and itself; null as a dash."""
    said = [x.cast("string") for x in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in said)), 256)


def joined(digests) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def depth_of(total: int, fanout: int = FANOUT) -> int:
    """Levels above the leaves."""
    n = 0
    while total > 1:
        total, n = -(-total // fanout), n + 1
    return n


def subtrees(digests: list[str], start: int, total: int, fanout: int = FANOUT) -> list[tuple[int, list[str]]]:
    """For each level (first, nodes): the nodes whose leaves all are among those from start on, of total in the group."""
    levels = [(start, digests)]
    while total > 1:
        first, nodes = levels[-1]
        end = first + len(nodes)
        # runs that start and end here; the group's last run may be short
        above, stop = -(-first // fanout), (-(-end // fanout) if end == total else end // fanout)
        levels.append((above, [joined(nodes[p * fanout - first : (p + 1) * fanout - first]) for p in range(above, stop)]))
        total = -(-total // fanout)
    return levels


def paths(digests: list[str], start: int, total: int, given: dict[tuple[int, int], str], fanout: int = FANOUT) -> Iterator[Proof]:
    """For each leaf from start on, its proof: for each level its place in the run and the run's other digests.

    given: by level and number, nodes that aren't made of these leaves alone."""
    levels = subtrees(digests, start, total, fanout)
    sizes = [total]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // fanout))
    known: dict[tuple[int, int], Proof] = {}

    def run(k: int, number: int) -> list[str]:
        first, nodes = levels[k]
        span = range(number * fanout, min(sizes[k], (number + 1) * fanout))
        return [nodes[x - first] if first <= x < first + len(nodes) else given[k, x] for x in span]

    def upwards(k: int, at: int) -> Proof:
        if k + 1 == len(sizes):
            return []
        if (k, at) not in known:
            own, place = run(k, at // fanout), at % fanout
            known[k, at] = [(place, own[:place] + own[place + 1 :]), *upwards(k + 1, at // fanout)]
        return known[k, at]

    end, at = start + len(digests), start
    while at < end:
        number = at // fanout
        own, higher = (run(0, number), upwards(1, number)) if total > 1 else ([], [])
        for x in range(at, min(end, (number + 1) * fanout)):
            place = x % fanout
            yield [(place, own[:place] + own[place + 1 :]), *higher] if own else []
        at = (number + 1) * fanout
        if len(known) > 1 << 14:
            known.clear()


def folded(leaf: str, proof: Proof) -> str:
    """The root that a leaf and its proof lead to."""
    for place, others in proof:
        leaf = joined([*others[:place], leaf, *others[place:]])
    return leaf


def _groups(batches, names: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of sorted batches in runs of equal values of the named columns (no nulls), over the batches' ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        new[0] = bool(held) and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in names)
        for c in names:
            new[1:] |= pc.not_equal(batch.column(c).slice(1), batch.column(c).slice(0, n - 1)).to_numpy(zero_copy_only=False)
        cuts = [0, *np.flatnonzero(new).tolist(), n]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if k and held:
                yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _spans(ranged: DataFrame) -> DataFrame:
    """part, grp, start, rows, total: where a partition's rows stand among their group's; one row for each pair."""
    counts = ranged.groupBy("part", "grp").agg(F.count("*").alias("rows"))
    own = W.partitionBy("grp")  # a row for each partition of a group
    before = F.coalesce(F.sum("rows").over(own.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return durable(counts.select("part", "grp", before.alias("start"), "rows", F.sum("rows").over(own).alias("total")))


def _ragged(ranged: DataFrame, crossing, fanout: int) -> DataFrame:
    """NODES without a parent that is made within their partition."""

    def run(batches):
        for rows in _groups(batches, ("part", "grp")):
            part, grp, leaves = rows["part"][0].as_py(), rows["grp"][0].as_py(), rows["leaf"].to_pylist()
            start, total = crossing.value.get((part, grp), (0, len(leaves)))
            levels, out = subtrees(leaves, start, total, fanout), []
            for k, (first, nodes) in enumerate(levels):
                above, made = levels[k + 1] if k + 1 < len(levels) else (0, [])
                covered = range(above * fanout, (above + len(made)) * fanout)
                out += [(grp, k, x, d, len(levels) - 1) for x, d in enumerate(nodes, first) if x not in covered]
            cols = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int32()), strict=True)], names=["grp", "level", "at", "digest", "depth"])

    return ranged.select("part", "grp", "leaf").mapInArrow(run, NODES)


def _run_of(fanout: int) -> Column:
    return F.floor(F.col("at") / fanout).cast("long")


class Tree:
    """The trees of groups of leaves (grp, ord, leaf, claimed): sorted leaves, spans, nodes that cross partitions, roots."""

    def __init__(self, leaves: DataFrame, part_rows: int = PART_ROWS, fanout: int = FANOUT) -> None:
        spark, rows = leaves.sparkSession, leaves.count()
        self.fanout = fanout
        self.parts = max(1, -(-rows // part_rows), min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // LEAST_ROWS))
        # identical rows are told apart by their place, lest they all fall into one range
        keys = ["grp", "ord", "leaf", "place"]
        ranged = leaves.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(self.parts, *keys).sortWithinPartitions(*keys)
        self.leaves = durable(ranged.drop("place").withColumn("part", F.spark_partition_id()))
        self.spans = _spans(self.leaves)
        # of a sorted partition only the first and the last group can cross its borders: two rows for each partition at most
        here: Crossing = {(r["part"], r["grp"]): (r["start"], r["total"]) for r in self.spans.where("rows < total").collect()}
        self.crossing = spark.sparkContext.broadcast(here)
        ragged = durable(_ragged(self.leaves, self.crossing, fanout))
        levels = [ragged.where("level = 0")]
        for k in range(max((depth_of(t, fanout) for _, t in here.values()), default=0)):
            # a run has fanout nodes at most; all of them are here, as their parent isn't made within a partition
            runs = levels[-1].where("level < depth").groupBy("grp", _run_of(fanout).alias("parent"))
            made = runs.agg(F.sort_array(F.collect_list(F.struct("at", "digest"))).alias("run"), F.first("depth").alias("depth"))
            made = made.select("grp", F.lit(k + 1).alias("level"), F.col("parent").alias("at"), F.sha2(F.array_join("run.digest", ""), 256).alias("digest"), "depth")
            levels.append(durable(made.unionByName(ragged.where(f"level = {k + 1}"))))
        deep = len(levels) - 1
        nodes = ragged.where(f"level = 0 or level > {deep}")
        for level in levels[1:]:
            nodes = nodes.unionByName(level)
        self.nodes = nodes.where("level < depth")
        self.roots = durable(nodes.where("level = depth").select("grp", F.col("digest").alias("root")))

    def lacking(self) -> DataFrame:
        """part, grp, level, nodes: of the runs that hold a border of a crossing group's rows, the nodes that cross partitions."""
        deep = max((depth_of(t, self.fanout) for _, t in self.crossing.value.values()), default=0)
        spec = F.array(*(F.struct(F.lit(k).alias("level"), F.lit(self.fanout**k).alias("below"), F.lit(self.fanout ** (k + 1)).alias("width")) for k in range(max(1, deep))))
        spans = self.spans.where("rows < total").withColumn("l", F.explode(spec)).where("total > l.below")
        borders = F.array_distinct(F.transform(F.array(F.col("start"), F.col("start") + F.col("rows") - 1), lambda x: F.floor(x / F.col("l.width")).cast("long")))
        wanted = durable(spans.select("part", "grp", "l.level", F.explode(borders).alias("run")))
        keys = ["grp", "level", "run"]
        held = self.nodes.groupBy("grp", "level", _run_of(self.fanout).alias("run")).agg(F.collect_list(F.struct("at", "digest")).alias("nodes"))
        counted = held.join(wanted.groupBy(*keys).agg(F.count("*").alias("n")), keys)
        # all partitions of a group want the runs below its root
        return spread_join(wanted, counted, keys, wanted.count()).select("part", "grp", "level", "nodes")

    def proofs(self, upper: DataFrame, root: str, full: bool) -> DataFrame:
        """ord, leaf, subroot, root, proof_sha256, folded_root, verified and, if full, proof, for every leaf.

        upper: part, grp, subroot and path, the proof from the group's root on. A partition's rows meet what they lack by
        going, slim as they are, to one partition again."""
        none = {"ord": self.leaves.schema["ord"].dataType, "leaf": "string", "claimed": "string", "level": "int", "nodes": "array<struct<at:bigint,digest:string>>", "subroot": "string", "path": PATH}

        def shaped(df: DataFrame, kind: int) -> DataFrame:
            return df.select("part", "grp", F.lit(kind).alias("kind"), *(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()))

        both = shaped(upper, 0).unionByName(shaped(self.lacking(), 1)).unionByName(shaped(self.leaves, 2))
        both = both.repartition(self.parts, "part").sortWithinPartitions("part", "grp", "kind", "ord", "leaf")
        crossing, fanout, step = self.crossing, self.fanout, 256 if full else 4096
        proof = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.list_(pa.string()))]))
        names = ["ord", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *(["proof"] if full else [])]

        def run(batches):
            from itertools import islice

            for rows in _groups(batches, ("part", "grp")):
                kinds = rows["kind"].to_numpy()
                few = rows.slice(0, int((kinds < 2).sum())).select(["kind", "level", "nodes", "subroot", "path"]).to_pylist()
                rows = rows.slice(len(few))
                above = [(p["place"], p["others"]) for p in few[0]["path"]]
                given = {(x["level"], n["at"]): n["digest"] for x in few[1:] for n in x["nodes"]}
                leaves = rows["leaf"].to_pylist()
                start, total = crossing.value.get((rows["part"][0].as_py(), rows["grp"][0].as_py()), (0, len(leaves)))
                made = paths(leaves, start, total, given, fanout)
                for at in range(0, len(leaves), step):
                    part = rows.slice(at, step).combine_chunks()
                    proven = [[*p, *above] for p in islice(made, part.num_rows)]
                    claims = pc.coalesce(part["claimed"], part["leaf"]).to_pylist()
                    folds = [folded(c, p) for c, p in zip(claims, proven, strict=True)]
                    digests = [joined(d for _, others in p for d in others) for p in proven]
                    n = len(proven)
                    cols = [part["ord"].combine_chunks(), part["leaf"].combine_chunks(), pa.array([few[0]["subroot"]] * n), pa.array([root] * n), pa.array(digests), pa.array(folds), pa.array([f == root for f in folds])]
                    if full:
                        cols.append(pa.array([[{"place": a, "others": o} for a, o in p] for p in proven], proof))
                    yield pa.RecordBatch.from_arrays(cols, names=names)

        kind = none["ord"].simpleString()
        return both.mapInArrow(run, f"ord {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + f", proof {PATH}" * full)


def manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    group: str = "source",
    order: str = "doc_id",
    claimed: dict[str, Column] | None = None,
    proofs: bool = False,
    part_rows: int = PART_ROWS,
    fanout: int = FANOUT,
) -> DataFrame:
    """order's column, leaf, subroot, root, proof_sha256, folded_root, verified for every row of docs; if proofs, each row's
    proof too: for each level from its leaf to the root its place in the run and the run's other digests.

    claimed: values that are claimed for a row in place of its own; folded_root is what they lead to with the row's proof."""
    session_of(docs)
    changed = F.lit(False)
    for c, x in (claimed or {}).items():
        changed = changed | ~x.eqNullSafe(col(c))
    said = F.when(changed, leaf_of([(claimed or {}).get(c, col(c)) for c in fields]))
    # a key without nulls that sorts like the group, nulls first
    grp = F.coalesce(F.concat(F.lit("="), col(group).cast("string")), F.lit(""))
    rows = durable(docs.select(grp.alias("grp"), col(order).alias("ord"), leaf_of([col(c) for c in fields]).alias("leaf"), said.alias("claimed")))
    tree = Tree(rows, part_rows, fanout)
    # the groups' roots are the leaves of a tree of the same make
    over = Tree(tree.roots.select(F.lit("").alias("grp"), F.col("grp").alias("ord"), F.col("root").alias("leaf"), F.lit(None).cast("string").alias("claimed")), part_rows, fanout)
    found = over.roots.first()  # of one group: one row
    root = found["root"] if found else ""
    end = over.spans.select("part", "grp", F.lit("").alias("subroot"), F.array().cast(PATH).alias("path"))
    tops = over.proofs(end, root, True).select(F.col("ord").alias("grp"), F.col("leaf").alias("subroot"), F.col("proof").alias("path"))
    shares = tree.spans.groupBy("grp").agg(F.count("*").alias("n"))
    upper = spread_join(tree.spans.select("part", "grp"), tops.join(shares, "grp"), ["grp"], tree.spans.count())
    return tree.proofs(upper, root, proofs).withColumnRenamed("ord", order)


def verified(proved: DataFrame, leaf: Column, root: str) -> Column:
    """Whether a leaf and the column proof lead to root; in the JVM, for checks of rows that come with their proofs."""
    step = lambda acc, p: F.sha2(F.concat(F.array_join(F.slice(p["others"], 1, p["place"]), ""), acc, F.array_join(F.slice(p["others"], p["place"] + 1, F.size(p["others"])), "")), 256)
    return F.aggregate(proved["proof"], leaf, step) == root


def tampered(doc_id: str = "doc_id", text: str = "text") -> dict[str, Column]:
    """Claims that put a text in lower case (A-Z) where 5 divides crc32 of the row's id (null: of an empty string)."""
    lower = F.translate(col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return {text: F.when(F.crc32(F.coalesce(col(doc_id).cast("string"), F.lit(""))) % 5 == 0, lower).otherwise(col(text))}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"), claimed=tampered())


def sql(docs: str = "documents", fanout: int = FANOUT, depth: int = 4) -> str:
    """DuckDB's equivalent, for groups of up to fanout ** depth rows and as many groups; the id is one that no two rows share."""
    said = lambda text: "sha256(concat(" + ", ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"
    # crc32 by its definition: each character, then eight shifts
    crc = """xor(4294967295, list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(doc_id::varchar, ''), lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end))"""
    out = f"""
with d as (select *, {crc} as crc from {docs}),
r as (select doc_id, source, {said("text")} as leaf, {said("case when crc % 5 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end")} as claim from d),
n0 as (select source as g, row_number() over (partition by source order by doc_id) - 1 as pos, count(*) over (partition by source) as n, leaf as h, doc_id from r)"""

    def levels(name: str) -> str:
        """Each level's nodes of every group, from name0: g, pos, n (nodes of the level), h."""
        return "".join(
            f""",
{name}{k + 1} as (select g, pos // {fanout} as pos, (n + {fanout - 1}) // {fanout} as n, sha256(string_agg(h, '' order by pos)) as h from {name}{k} where n > 1 group by g, pos // {fanout}, n)"""
            for k in range(depth)
        )

    def roots(name: str) -> str:
        return " union all ".join(f"select g, h from {name}{k} where n = 1" for k in range(depth + 1))

    out += levels("n") + f""",
roots as ({roots("n")}),
t0 as (select 1 as g, row_number() over (order by g nulls first) - 1 as pos, count(*) over () as n, h, g as source from roots){levels("t")},
root as ({roots("t")}),
p0 as (select n0.doc_id, n0.g as source, n0.pos, t0.pos as top, n0.h as leaf, roots.h as subroot, root.h as root, '' as proof, r.claim as fold
  from n0 join r using (doc_id) join roots on roots.g is not distinct from n0.g join t0 on t0.source is not distinct from n0.g cross join root)"""
    step = 0
    for name, place, on in (("n", "pos", "x.g is not distinct from p.source"), ("t", "top", "true")):
        for k in range(depth):
            width = fanout**k
            here = f"p.{place} // {width}"
            out += f""",
p{step + 1} as (select p.doc_id, any_value(p.source) as source, any_value(p.pos) as pos, any_value(p.top) as top, any_value(p.leaf) as leaf, any_value(p.subroot) as subroot, any_value(p.root) as root,
    any_value(p.proof) || coalesce(string_agg(case when x.pos <> {here} then x.h end, '' order by x.pos), '') as proof, case when count(x.h) = 0 then any_value(p.fold) else sha256(string_agg(case when x.pos = {here} then p.fold else x.h end, '' order by x.pos)) end as fold
  from p{step} p left join {name}{k} x on x.n > 1 and {on} and x.pos // {fanout} = {here} // {fanout} group by p.doc_id)"""
            step += 1
    return out + f"""
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, fold as folded_root, fold = root as verified from p{step}
"""
