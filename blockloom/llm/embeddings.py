"""Embedding near-duplicates: int8 tile products with rigorous error bounds, full precision only where they leave doubt.

Vectors are compared within their label. Equal vectors of a label are one class with a multiplicity, so copies are
never compared. A label's classes are dealt by hash to blocks of about BLOCK vectors; each pair of blocks is one task's
work, whatever the label's size, compared tile by tile (TILE vectors a side), and a vector travels once for each block
of its label: n * ceil(n / BLOCK) vectors of a label of n. All pairs of tiles are compared, so the products grow with
the square of a label; what travels does so from BLOCK distinct vectors of one label on, at 1 / BLOCK of it.

A unit vector u is stored as s * q with q in int8; e = |u - s q| is its exact quantisation error. For two of them
|u.v - s_u s_v q_u.q_v| <= e_u + (1 + e_u) e_v, and q_u.q_v is exact in float32 products over up to 1,024 components.
Pairs that may reach the threshold by that bound are recomputed in double precision from the given vectors.

A vector that is null, empty, zero, of a null label or holds null or non-finite components links with nothing, nor do
vectors of different lengths. Empty table: empty result. Repeated ids are separate vectors of one id. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, durable, session_of, spread_join, table
from .components import components
from .graphs import forest, forest_between

THRESHOLD, TILE, BLOCK = 0.93, 2048, 16_384
_EXACT, _PAIRS = 1024, 1 << 16
SLACK = 1e-9  # far above the rounding of the double-precision bounds


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and error norms of the unit vectors along the rows of x (double, not zero)."""
    u = x / np.abs(x).max(1, keepdims=True)
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    s = np.abs(u).max(1) / 127
    q = np.rint(u / s[:, None])
    return q.astype(np.int8), s, np.sqrt(((u - s[:, None] * q) ** 2).sum(1))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows, by float32 matrix products over few enough components."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], _EXACT):
        out += a[:, k : k + _EXACT].astype(np.float32) @ b[:, k : k + _EXACT].astype(np.float32).T
    return out


def linked(x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Boolean matrix: cosine >= threshold in double precision."""
    qx, sx, ex = quantise(x)
    qy, sy, ey = quantise(y)
    about = _product(qx, qy)
    about *= sx[:, None]
    about *= sy[None, :]
    about += ex[:, None] + (1 + ex)[:, None] * ey[None, :] + SLACK
    doubt = np.argwhere(about >= threshold)
    out = np.zeros(about.shape, bool)
    scaled = [v / np.abs(v).max(1, keepdims=True) for v in (x, y)]
    norms = [np.sqrt((v * v).sum(1)) for v in scaled]
    for k in range(0, len(doubt), _PAIRS):
        i, j = doubt[k : k + _PAIRS].T
        out[i, j] = (scaled[0][i] * scaled[1][j]).sum(1) / (norms[0][i] * norms[1][j]) >= threshold
    return out


def _works(batches, keys: int):
    """Record batches sorted by their first `keys` columns, as one table for each key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ks = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for k in ks:
            new[1:] |= k[1:] != k[:-1]
        edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        if held and any(held[0].column(k)[0].as_py() != ks[k][0] for k in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _matrix(t: pa.Table) -> np.ndarray:
    v = t.column("v").combine_chunks()
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors."""
    session_of(vectors)
    rows = vectors.select(col(vec_id).alias("vec_id"), col(label).alias("l"), col(embedding).alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.coalesce(F.col("l").isNotNull() & ~odd & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.select("vec_id", F.when(sound, F.col("l")).alias("l"), F.when(sound, F.col("v")).alias("v"))
    classes = durable(rows.where("v is not null").groupBy("l", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumn("c", F.monotonically_increasing_id()))
    # a few figures for each label; labels that are very many shuffle, as any key does
    groups = durable(classes.groupBy("l", F.size("v").alias("dim")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("own")).withColumn("g", F.monotonically_increasing_id()))
    work = spread_join(classes.withColumn("dim", F.size("v")), groups, ["l", "dim"], classes.count(), "own").withColumn("t", F.pmod(F.xxhash64("c"), "blocks").cast("int"))
    work = work.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    work = work.select("g", F.least("t", "o").alias("t1"), F.greatest("t", "o").alias("t2"), "t", "c", "n", "v")
    work = work.repartition("g", "t1", "t2").sortWithinPartitions("g", "t1", "t2", "t")

    def run(batches):
        for t in _works(batches, 3):
            block, c, n = t.column("t").to_numpy(), t.column("c").to_numpy(), t.column("n").to_numpy()
            first = int((block == t.column("t1")[0].as_py()).sum())  # rows of the first block stand before the second's
            ends = [0, *range(TILE, first, TILE), first, *range(first + TILE, len(c), TILE), len(c)]
            tiles = [(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True) if a < b]
            sums, pairs = np.zeros(len(c), np.int64), []
            for i, (a, b) in enumerate(tiles):
                # within one block each pair of tiles, between two each tile of the one with each of the other
                others = tiles[i:] if first == len(c) else [x for x in tiles if x[0] >= first] if a < first else []
                x = _matrix(t.slice(a, b - a)) if others else None
                for p, q in others:
                    if p == a:
                        m = linked(x, x, threshold)
                        m |= m.T
                        np.fill_diagonal(m, False)
                        sums[a:b] += m @ n[a:b]
                        pairs += [(c[a + j], c[a + k]) for j, k in forest(m)]
                    else:
                        m = linked(x, _matrix(t.slice(p, q - p)), threshold)
                        sums[a:b] += m @ n[p:q]
                        sums[p:q] += n[a:b] @ m
                        pairs += [(c[a + j], c[p + k]) for j, k in forest_between(m)]
            ids, sums = c[sums > 0], sums[sums > 0]
            two = np.array(pairs, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((ids, two[:, 0]))), pa.array([None] * len(ids) + two[:, 1].tolist(), pa.int64()), pa.array(np.concatenate((sums, np.zeros(len(two), np.int64))))], names=["c", "other", "n"]
            )

    found = durable(work.mapInArrow(run, "c long, other long, n long"))
    counts = found.groupBy("c").agg(F.sum("n").alias("beside"))
    roots = components(found.where("other is not null").select(F.col("c").alias("a"), F.col("other").alias("b")))
    met = durable(classes.join(counts, "c", "left").join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c")))
    least = met.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("classes"))
    met = spread_join(met, least, ["root"], met.count(), "classes").select("l", "v", (F.coalesce("beside", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id", "n")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = spread_join(rows.where("v is not null"), met, ["l", "v"], rows.count()).select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("component_id").eqNullSafe(F.col("vec_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def sql(threshold: float = THRESHOLD) -> str:
    dot = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::double * p[2]::double))"
    return f"""
with recursive e as (select vec_id, label, embedding::double[] as v, sqrt({dot.format(a='embedding::double[]', b='embedding::double[]')}) as norm from embeddings where label is not null and embedding is not null),
p as (select a.vec_id as x, b.vec_id as y from e a join e b on a.label = b.label and a.vec_id < b.vec_id and len(a.v) = len(b.v) where {dot.format(a='a.v', b='b.v')} / (a.norm * b.norm) >= {threshold}),
s as (select x, y from p union all select y, x from p),
reach(x, y) as (select vec_id, vec_id from embeddings union select reach.x, s.y from reach join s on s.x = reach.y),
c as (select x as vec_id, min(y) as component_id from reach group by x),
n as (select x as vec_id, count(*) as n from s group by x)
select c.vec_id, coalesce(n.n, 0)::bigint as n_links, component_id, c.vec_id = component_id as kept from c left join n using (vec_id)
"""
