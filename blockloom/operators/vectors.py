"""Exact vector search, and an index on disk.

Few queries (QUERY_BYTES of vectors at most) are broadcast and the vectors are scanned once, where they are. More queries meet
the vectors as rows: vectors are dealt to tiles by bytes, each query goes to every tile that may hold a hit, and one task
multiplies a tile with its queries, slice by slice. Either way a task keeps only what reaches a query's k-th best score so
far, so what is shuffled is at most k rows for each query and tile; a window over these gives the k best of all.

The index deals vectors to cells around centroids, which are fitted on a bounded sample, and keeps each cell's radius, the
widest angle between its centroid and a vector in it. By the triangle inequality of angles no vector in a cell can be nearer
to a query than the angle to its centroid less its radius. A search first meets the nearest cells of each query; the exact
mode then also those cells whose bound reaches the k-th best score found, so it gives what a full search gives."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..arrow import runs
from ..shared import durable

QUERY_BYTES, TILE_BYTES, QUERY_ROWS, SCAN_ROWS, DECIMALS = 16 << 20, 32 << 20, 1024, 2048, 6
#: Of an index: cells at most, rows that their centroids are fitted on at most, rounds of fitting, cells probed at first.
MAX_CELLS, SAMPLE, FITS, PROBES = 4096, 20_000, 12, 8
SLACK = 2e-6  # radians and cosines: of rounding, in favour of another look


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(n > 0, n, 1)


def by_length(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: numbers of the rows that are sound vectors, and those as a matrix of unit vectors. Read from Arrow's own buffers."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    flat = column.flatten()
    holes = flat.is_null().to_numpy(zero_copy_only=False) if flat.null_count else None
    values = (pc.fill_null(flat, np.nan) if flat.null_count else flat).to_numpy(zero_copy_only=False).astype(np.float64)
    out = {}
    for dim in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == dim)
        pick = (ends[at] - dim)[:, None] + np.arange(dim)
        m = values[pick]
        sound = np.isfinite(m).all(1) & (m != 0).any(1)
        if holes is not None:
            sound &= ~holes[pick].any(1)
        if sound.any():
            out[dim] = at[sound], _unit(m[sound])
    return out


def _names(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), object)


class Best:
    """The k best hits of some queries: what doesn't reach a query's k-th best so far is never kept. Ties go by id."""

    def __init__(self, queries: int, k: int, floor: np.ndarray | None = None) -> None:
        self.k, self.kth, self.parts, self.waiting = k, np.full(queries, -np.inf) if floor is None else floor.copy(), [], 0
        self.floor = self.kth.copy()

    def add(self, number: np.ndarray, ids: np.ndarray, scores: np.ndarray, bad: np.ndarray | None = None) -> None:
        """scores: of the queries number and the vectors ids, as a matrix."""
        if bad is not None:
            scores[bad] = -np.inf
        least = self.kth[number]
        if scores.shape[1] > self.k and np.isneginf(least).any():
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        r, c = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
        if len(r):
            self.parts.append((number[r], ids[c], scores[r, c]))
            self.waiting += len(r)
            if self.waiting > max(4096, self.k * len(self.kth) // 2):
                self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's number, id, score), each query's best first."""
        if not self.parts:
            return np.zeros(0, int), np.zeros(0, object), np.zeros(0)
        row, ids, score = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((np.array(ids.tolist()), -score, row))
        row, ids, score = row[order], ids[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        full = place == self.k - 1
        self.kth[row[full]] = np.maximum(self.floor[row[full]], score[full])
        keep = place < self.k
        self.parts, self.waiting = [(row[keep], ids[keep], score[keep])], 0
        return self.parts[0]


def _bytes(rows: DataFrame) -> int:
    return rows.agg(F.sum(F.size("e") * 8 + 64).alias("b")).first()["b"] or 0


def _fields(df: DataFrame, names: tuple[str, ...]):
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(df.schema[n].dataType) for n in names]


def top_k(queries: DataFrame, vectors: DataFrame, k: int, threshold: float | None = None, qid: str = "vec_id", vid: str = "vec_id", embedding: str = "embedding", same: str | None = None, self_match: bool = False) -> DataFrame:
    """query_id, vec_id, score, rank: the k best by cosine (rounded to 6 digits; ties by id), of threshold and more.

    same: a column in which query and vector must agree. self_match: whether a row may find its own id. Vectors that are
    null, zero or not finite find nothing and are not found; others meet those of their own length. Ids of any type."""
    of = F.col(same) if same else F.lit(0)
    q = queries.select(F.col(qid).alias("q"), F.col(embedding).cast("array<double>").alias("e"), of.alias("of")).where("e is not null and q is not null")
    v = vectors.select(F.col(vid).alias("v"), F.col(embedding).cast("array<double>").alias("e"), of.alias("of")).where("e is not null and v is not null")
    if _bytes(q) <= QUERY_BYTES:
        found = _scanned(q, v, k, threshold, self_match)
    else:
        tiles = max(1, -(-_bytes(v) // TILE_BYTES))
        asked = q.withColumns({"floor": F.lit(threshold).cast("double"), "tile": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long")))})
        found = _met(asked.withColumn("cell", F.lit("")), v.withColumns({"cell": F.lit(""), "tile": F.pmod(F.xxhash64("v"), F.lit(tiles))}), k, self_match)
    return ranked(found, k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _scanned(q: DataFrame, v: DataFrame, k: int, threshold: float | None, self_match: bool) -> DataFrame:
    """Each task's k best for every query of a bounded set, by one scan of the vectors."""
    rows = q.collect()  # QUERY_BYTES at most
    by = by_length(pa.array([r["e"] for r in rows], pa.list_(pa.float64())))
    sent = v.sparkSession.sparkContext.broadcast((_names(pa.array([r["q"] for r in rows])) if rows else np.zeros(0, object), np.array([r["of"] for r in rows], object), by))
    kinds = _fields(q, ("q",)) + _fields(v, ("v",))

    def run(batches):
        names, groups, by = sent.value
        best = Best(len(names), k, None if threshold is None else np.full(len(names), float(threshold)))
        for whole in batches:
            for at in range(0, whole.num_rows if len(names) else 0, SCAN_ROWS):
                batch = whole.slice(at, SCAN_ROWS)
                known, of = _names(batch.column(0)), _names(batch.column(2))
                for dim, (ok, m) in by_length(batch.column(1)).items():
                    if dim not in by:
                        continue
                    for first in range(0, len(by[dim][0]), QUERY_ROWS):
                        number, x = (y[first : first + QUERY_ROWS] for y in by[dim])
                        bad = groups[number][:, None] != of[ok][None, :]
                        if not self_match:
                            bad |= names[number][:, None] == known[ok][None, :]
                        best.add(number, known[ok], np.round(x @ m.T, DECIMALS), bad)
        row, ids, score = best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(names[row].tolist(), kinds[0]), pa.array(ids.tolist(), kinds[1]), pa.array(score)], names=["query_id", "vec_id", "score"])

    return v.mapInArrow(run, f"query_id {q.schema['q'].dataType.simpleString()}, vec_id {v.schema['v'].dataType.simpleString()}, score double")


def _met(q: DataFrame, v: DataFrame, k: int, self_match: bool) -> DataFrame:
    """Each tile's k best for every query that is sent to it. q: cell, tile, q, e, of, floor; v: cell, tile, v, e, of."""
    kinds = q.schema["q"].dataType, v.schema["v"].dataType
    none = lambda t: F.lit(None).cast(t)
    of = v.schema["of"].dataType
    left = v.select("cell", "tile", F.lit(0).alias("kind"), "v", none(kinds[0]).alias("q"), "e", "of", none("double").alias("floor"))
    right = q.select("cell", "tile", F.lit(1).alias("kind"), none(kinds[1]).alias("v"), "q", "e", F.col("of").cast(of).alias("of"), "floor")
    both = left.unionByName(right).repartition("cell", "tile").sortWithinPartitions("cell", "tile", "kind")
    arrow = _fields(q, ("q",)) + _fields(v, ("v",))

    def run(batches):
        held: list[pa.RecordBatch] = []
        tile: tuple | None = None
        for new, part in runs(batches, ("cell", "tile", "kind")):
            if part.column("kind")[0].as_py() == 0:
                held, tile = ([part] if new else [*held, part]), None
                continue
            if new and held and any(held[0].column(c)[0] != part.column(c)[0] for c in ("cell", "tile")):
                held, tile = [], None
            if not held:
                continue
            if tile is None:
                rows = pa.Table.from_batches(held).combine_chunks()
                tile = _names(rows["v"]), _names(rows["of"]), by_length(rows["e"].combine_chunks())
            ids, groups, by = tile
            for at in range(0, part.num_rows, QUERY_ROWS):
                batch = part.slice(at, QUERY_ROWS)
                names, own = _names(batch.column("q")), _names(batch.column("of"))
                floor = pc.fill_null(batch.column("floor"), -np.inf).to_numpy(zero_copy_only=False).astype(float)
                best = Best(len(names), k, floor)
                for dim, (number, x) in by_length(batch.column("e")).items():
                    for first in range(0, len(by[dim][0]) if dim in by else 0, SCAN_ROWS):
                        ok, m = (y[first : first + SCAN_ROWS] for y in by[dim])
                        bad = own[number][:, None] != groups[ok][None, :]
                        if not self_match:
                            bad |= names[number][:, None] == ids[ok][None, :]
                        best.add(number, ids[ok], np.round(x @ m.T, DECIMALS), bad)
                row, found, score = best.settle()
                yield pa.RecordBatch.from_arrays([pa.array(names[row].tolist(), arrow[0]), pa.array(found.tolist(), arrow[1]), pa.array(score)], names=["query_id", "vec_id", "score"])

    return both.mapInArrow(run, f"query_id {kinds[0].simpleString()}, vec_id {kinds[1].simpleString()}, score double")


def centroids(m: np.ndarray, cells: int, seed: int = 5) -> np.ndarray:
    """Directions that unit vectors gather around, by rounds of assignment and mean."""
    rng = np.random.default_rng(seed)
    out = m[rng.choice(len(m), min(cells, len(m)), replace=False)]
    for _ in range(FITS):
        near = np.concatenate([(m[at : at + 4096] @ out.T).argmax(1) for at in range(0, len(m), 4096)])
        sums = np.zeros_like(out)
        np.add.at(sums, near, m)
        full = np.bincount(near, minlength=len(out)) > 0
        out = _unit(np.where(full[:, None], sums, out))
    return out


def build_index(vectors: DataFrame, folder: str, cells: int | None = None, sample: int = SAMPLE, vid: str = "vec_id", embedding: str = "embedding") -> None:
    """Writes vectors by cell, and the cells, below folder. cells: of each length of vectors, by default the root of their number.

    Every sound vector is in the index; sample bounds only the rows that centroids are fitted on (least hash of the id)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vid).alias("v"), F.col(embedding).cast("array<double>").alias("e")).where("v is not null and size(e) > 0")
    n = rows.count()
    hashed = F.pmod(F.xxhash64("v"), F.lit(1 << 40))
    some = rows.where(hashed <= int((1 << 40) * min(1.0, 1.5 * sample / max(1, n)))).orderBy(hashed, "v").limit(sample).collect()
    wanted = min(MAX_CELLS, cells or max(1, round(n**0.5)))
    centres = {dim: centroids(m, wanted) for dim, (_, m) in by_length(pa.array([r["e"] for r in some], pa.list_(pa.float64()))).items()}
    sent = spark.sparkContext.broadcast(centres)  # MAX_CELLS of each length of the sample

    def assign(batches):
        for batch in batches:
            cell, angle = [None] * batch.num_rows, np.zeros(batch.num_rows)
            for dim, (ok, m) in by_length(batch.column("e")).items():
                c = sent.value.get(dim)
                s = m @ c.T if c is not None else None  # vectors of lengths that the sample lacks are one cell
                best = s.argmax(1) if c is not None else np.zeros(len(ok), int)
                angle[ok] = np.arccos(np.clip(s[np.arange(len(ok)), best], -1, 1)) if c is not None else np.pi
                for i, b in zip(ok.tolist(), best.tolist(), strict=True):
                    cell[i] = f"{dim}-{b}"
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.string()), pa.array(angle)], names=["v", "e", "cell", "angle"])

    kind = rows.schema["v"].dataType.simpleString()
    assigned = durable(rows.mapInArrow(assign, f"v {kind}, e array<double>, cell string, angle double").where("cell is not null"))
    size = F.sum(F.size("e") * 8 + 64)
    sizes = durable(assigned.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"), F.greatest(F.lit(1), F.ceil(size / TILE_BYTES)).cast("long").alias("tiles")))
    known = {f"{dim}-{i}": c.tolist() for dim, m in centres.items() for i, c in enumerate(m)}
    table = spark.createDataFrame(list(known.items()), "cell string, centre array<double>") if known else None
    out = sizes.join(table, "cell", "left") if known else sizes.withColumn("centre", F.lit(None).cast("array<double>"))
    out.coalesce(1).write.mode("overwrite").parquet(f"{folder}/cells")
    dealt = assigned.join(F.broadcast(sizes.select("cell", "tiles")), "cell")  # MAX_CELLS of each length
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("v"), F.col("tiles"))).select("v", "e", "cell", "tile")
    dealt.repartition("cell", "tile").write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/vectors")


def search_index(spark: SparkSession, folder: str, queries: DataFrame, k: int, threshold: float | None = None, probes: int = PROBES, exact: bool = True, qid: str = "vec_id", embedding: str = "embedding", self_match: bool = False) -> DataFrame:
    """What top_k() gives, of an index. Without exact only the probes nearest cells of each query are met."""
    cells = {r["cell"]: (r["radius"] + SLACK, r["tiles"], r["centre"]) for r in spark.read.parquet(f"{folder}/cells").collect()}  # MAX_CELLS of each length
    by: dict[int, tuple] = {}
    for dim in {int(c.split("-")[0]) for c in cells}:
        own = [c for c in cells if c.startswith(f"{dim}-")]
        centre = np.array([cells[c][2] if cells[c][2] is not None else [np.nan] * dim for c in own])
        by[dim] = np.array(own, object), centre, np.array([cells[c][0] for c in own]), np.array([cells[c][1] for c in own])
    sent = spark.sparkContext.broadcast(by)
    wanted = queries.select(F.col(qid).alias("q"), F.col(embedding).cast("array<double>").alias("e")).where("e is not null and q is not null")
    kind = wanted.schema["q"].dataType.simpleString()

    if not cells:
        return spark.createDataFrame([], f"query_id {kind}, vec_id {kind}, score double, rank int")

    def cells_of(rest: bool):
        def run(batches):
            for batch in batches:
                who, cell, tiles = [], [], []
                for dim, (ok, m) in by_length(batch.column("e")).items():
                    if dim not in sent.value:
                        continue
                    own, centre, radius, parts = sent.value[dim]
                    s = np.where(np.isnan(centre).any(1)[None, :], 1.0, m @ np.nan_to_num(centre).T)
                    near = np.zeros(s.shape, bool)
                    np.put_along_axis(near, np.argsort(-s, axis=1, kind="stable")[:, :probes], True, axis=1)
                    if rest:
                        bound = np.cos(np.maximum(0, np.arccos(np.clip(s, -1, 1)) - radius[None, :]))
                        least = pc.fill_null(batch.column("floor"), -np.inf).to_numpy(zero_copy_only=False).astype(float)[ok]
                        near = ~near & (bound + SLACK >= least[:, None])
                    r, c = np.nonzero(near)
                    who += ok[r].tolist()
                    cell += own[c].tolist()
                    tiles += parts[c].tolist()
                rows = batch.take(pa.array(who, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("q", "e", "floor")), pa.array(cell, pa.string()), pa.array(tiles, pa.int64())], names=["q", "e", "floor", "cell", "tiles"])

        return run

    vectors = spark.read.parquet(f"{folder}/vectors").withColumn("of", F.lit(0))
    vectors = vectors.withColumn("cell", F.col("cell").cast("string"))

    def met(asked: DataFrame, rest: bool) -> DataFrame:
        pairs = durable(asked.mapInArrow(cells_of(rest), f"q {kind}, e array<double>, floor double, cell string, tiles long"))
        # only the folders of cells that are asked for are read; a query goes to each tile of a cell
        used = vectors.join(F.broadcast(pairs.select("cell").distinct()), "cell", "left_semi")
        dealt = pairs.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).withColumn("of", F.lit(0))
        return _met(dealt, used, k, self_match)

    first = met(wanted.withColumn("floor", F.lit(threshold).cast("double")), False)
    if not exact:
        return ranked(first, k)
    first = durable(ranked(first, k).drop("rank"))
    # the k-th best so far: what is below can't be among the best
    reached = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") == k).select(F.col("query_id").alias("q"), "s")
    least = F.greatest("s", F.lit(threshold).cast("double"))
    second = met(wanted.join(reached, "q", "left").select("q", "e", least.alias("floor")), True)
    return ranked(first.unionByName(second), k)
