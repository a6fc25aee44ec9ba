"""Links that the fingerprints' radius misses: five-word shingles of 0.8 and more in common.

SimHash within 3 of 64 bits finds copies and nearly equal texts. Two texts with a Jaccard similarity of 0.8 differ in
about 10 bits, beyond any radius that anchors can prune. So that "near-duplicate" means 0.8 here, the operator's
deduplicate() adds candidates from the same shingle hashes: the least hashes under PERMUTATIONS linear permutations, in
bands of ROWS; texts that agree in a band meet, and the share of agreeing least hashes estimates their similarity
(standard error 0.035 at 0.8). A pair of 0.8 shares a band with a chance of 0.9999, and its estimate reaches LEAST with
one of 0.99998. The estimate only proposes: links() gives groups of candidates, and confirmed() compares the whole sets
of shingle hashes of a group's pairs whose estimate reaches LEAST; they link if the similarity is SIMILARITY or more.

Only bands that different fingerprints share are kept, and only their texts' sketches travel (256 bytes). A band's
members are compared among each other; of bands of over TILE members, first with LEADERS of them, and only what that
leaves apart is compared with all; groups of candidates alike. Each comparison gives a forest of links, never all pairs.
Sets travel once, for texts that have candidates only; of groups of over TILE texts, the leaders' go to each tile.
Texts without words have no sketch and are left to their fingerprints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PARTS, durable, spread_join
from .graphs import forest, forest_between

PERMUTATIONS, ROWS, SIMILARITY = 128, 5, 0.8
BANDS = PERMUTATIONS // ROWS
#: What the estimate of a candidate must reach: over four standard errors below.
LEAST = SIMILARITY - 0.15
TILE, LEADERS = 512, 16
#: A tile's sets, in bytes, as aimed at: a group's texts are dealt by their number and by the size of their sets.
TILE_BYTES = 16 << 20
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)


def minima(hashes: np.ndarray, least: np.ndarray | None = None) -> np.ndarray:
    """The least of each permutation of distinct shingle hashes (uint64), continued from earlier ones."""
    out = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64) if least is None else least
    a, b = _A[:, None], _B[:, None]
    for at in range(0, len(hashes), 1024):
        np.minimum(out, (a * hashes[None, at : at + 1024] + b).min(1), out=out)
    return out


def bands(least: np.ndarray) -> list[int]:
    """A key for each band, its number included."""
    rows = least[: BANDS * ROWS].reshape(BANDS, ROWS)
    key = np.full(BANDS, 0x9E3779B97F4A7C15, np.uint64) * np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = (key ^ rows[:, k]) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    return key.view(np.int64).tolist()


def sketch(least: np.ndarray) -> bytes:
    """The upper 16 bits of each of the least hashes' mixes."""
    return ((least * np.uint64(0xC4CEB9FE1A85EC53)) >> np.uint64(48)).astype("<u2").tobytes()


def agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Matrix: how many least hashes agree, for rows of sketches (uint16)."""
    out = np.empty((len(x), len(y)), np.int16)
    step = max(1, (1 << 22) // max(1, y.size))
    for at in range(0, len(x), step):
        out[at : at + step] = (x[at : at + step, None, :] == y[None, :, :]).sum(2)
    return out


def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Boolean matrix: the estimate reaches LEAST."""
    return agreeing(x, y) >= int(np.ceil(LEAST * PERMUTATIONS))


def near(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets (sorted, distinct) share SIMILARITY of their hashes; no rounding: 4/5."""
    if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 5 * both >= 4 * (len(x) + len(y) - both)


def near_forest(x: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges that join what near pairs join, of sketches and sets; likelier pairs first, pairs already joined not at all."""
    agree = np.triu(agreeing(x, x), 1)
    i, j = np.nonzero(agree >= int(np.ceil(LEAST * PERMUTATIONS)))
    label, out = np.arange(len(x)), []
    for k in np.argsort(-agree[i, j], kind="stable").tolist():
        a, b = int(i[k]), int(j[k])
        if label[a] != label[b] and near(sets[a], sets[b]):
            label[label == label[b]] = label[a]
            out.append((a, b))
    return out


def _matches(work: pa.Table, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Boolean matrix between two selections of rows: near, or alike where there are no sets."""
    x = _vectors(work.column("sketch"))
    m = alike(x[a], x[b])
    if "hashes" in work.column_names:
        sets = _sets(work.column("hashes"))
        own, other = np.flatnonzero(a), np.flatnonzero(b)
        for i, j in zip(*np.nonzero(m), strict=True):
            m[i, j] = near(sets[own[i]], sets[other[j]])
    return m


def _sets(column) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), "<u8") for v in column]


def _vectors(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, PERMUTATIONS)


def _edges(pairs: list) -> pa.RecordBatch:
    e = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(e.min(1)), pa.array(e.max(1))], names=["a", "b"])


def links(sketches: DataFrame) -> DataFrame:
    """(a, b): fingerprints of candidates, by estimate. sketches: fp, bands, sketch; one row for each fingerprint."""
    members = sketches.select(F.explode("bands").alias("band"), "fp")
    # partial minima, maxima and counts: a band that all texts share is one row for each task
    shared = durable(members.groupBy("band").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("band", "n"))
    hot, total = shared.where(F.col("n") > TILE), shared.agg(F.sum("n").alias("n")).first()["n"] or 0
    some = not hot.isEmpty()
    # rows of the hottest bands, PARTS at most, leave before the others are shuffled
    calm = members.join(F.broadcast(_hottest(hot, total)), "band", "left_anti") if some else members
    calm = calm.join(shared.where(F.col("n") <= TILE).select("band"), "band").join(sketches.select("fp", "sketch"), "fp")
    calm = by_band(calm).select("band", "fp", "sketch")

    def run(batches):
        from .embeddings import _works

        for work in _works(batches, 1):
            fp, x = work.column("fp").to_numpy(), _vectors(work.column("sketch"))
            yield _edges([(fp[i], fp[j]) for i, j in forest(alike(x, x))])

    out = calm.mapInArrow(run, "a long, b long")
    if some:
        hot = hot.withColumn("nj", F.ceil(F.col("n") / TILE).cast("int"))
        out = out.unionByName(_hot_links(members, hot, sketches.select("fp", "sketch"), total))
    return out.distinct()


def by_band(rows: DataFrame) -> DataFrame:
    """Rows with each band in one task, sorted by it. Dealt by a hash of the band: a shuffle by the band itself would be taken for
    one with the join by band before it, whose pieces the adaptive planner may then read where they lie, each band in many tasks."""
    return rows.repartition(F.xxhash64("band")).sortWithinPartitions("band")


def _hottest(hot: DataFrame, total: int) -> DataFrame:
    """The bands that hold more than their share of all members: PARTS at most."""
    return hot.where(F.col("n") > max(TILE, total // PARTS)).select("band")


def confirmed(groups: DataFrame, sets: DataFrame, widths: DataFrame) -> DataFrame:
    """(a, b): fingerprints of texts that share SIMILARITY of their shingles, enough to join all such pairs of a group.

    groups: node, root, of candidates. sets: fp, sketch, hashes (the whole set, sorted, uint64); widths: fp, width (how many
    hashes); both of those nodes."""
    members = groups.select(F.col("root").alias("band"), F.col("node").alias("fp"))
    sizes = members.join(widths, "fp").groupBy("band").agg(F.count("*").alias("n"), (F.sum("width") * 8).alias("bytes"))
    tiles = F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("bytes") / TILE_BYTES)).cast("int")
    hot = durable(sizes.select("band", "n", tiles.alias("nj")).where("nj > 1 and n > 1"))
    some, total, calm = not hot.isEmpty(), groups.count(), members
    if some:
        sets = durable(sets)
        calm = members.join(F.broadcast(_hottest(hot, total)), "band", "left_anti").join(hot.select("band"), "band", "left_anti")
    calm = calm.join(sets, "fp")
    calm = by_band(calm).select("band", "fp", "sketch", "hashes")

    def run(batches):
        from .embeddings import _works

        for work in _works(batches, 1):
            fp = work.column("fp").to_numpy()
            yield _edges([(fp[i], fp[j]) for i, j in near_forest(_vectors(work.column("sketch")), _sets(work.column("hashes")))])

    out = calm.mapInArrow(run, "a long, b long")
    return out.unionByName(_hot_links(members, hot, sets, total)) if some else out


def _hot_links(members: DataFrame, hot: DataFrame, sketches: DataFrame, total: int) -> DataFrame:
    """Links within bands of many members, that join all that all their links would; near ones if sketches have hashes.

    LEADERS of a band's members are compared with all of them. What is linked to leaders that are linked to each other
    is one component; only the members outside a band's largest such component are then compared with all its members,
    in tiles. For a group of near copies nearly nobody is outside, and the work is linear in the group."""
    tile = lambda n: F.pmod(F.xxhash64("fp"), n).cast("int")
    own = spread_join(members, hot.select("band", "nj", "n"), ["band"], total)
    chosen = own.groupBy("band", "nj", F.pmod(F.xxhash64("fp"), F.lit(LEADERS)).cast("int").alias("k")).agg(F.min("fp").alias("fp"))
    led = chosen.select("band", F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"), "k", "fp")
    first = own.select("band", tile(F.col("nj")).alias("j"), F.lit(-1).alias("k"), "fp").unionByName(led)
    held = [c for c in sketches.columns if c != "fp"]
    first = first.join(sketches, "fp").repartition("band", "j").sortWithinPartitions("band", "j", "k").select("band", "j", "k", "fp", *held)

    def with_leaders(batches):
        from .embeddings import _works

        for work in _works(batches, 2):
            k, fp = work.column("k").to_numpy(), work.column("fp").to_numpy()
            lead, rows = k >= 0, k < 0
            m = _matches(work, rows, lead)
            masks = (m.astype(np.int64) << k[lead].astype(np.int64)[None, :]).sum(1)
            ids = fp[lead]
            column = work.column("hashes" if "hashes" in work.column_names else "sketch")
            size = pc.binary_length(column).to_numpy()[rows].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(int(rows.sum()), work.column("band")[0].as_py(), np.int64)), pa.array(fp[rows]), pa.array(masks), pa.array([ids[r].tolist() for r in m], pa.list_(pa.int64())), pa.array(size)], names=["band", "fp", "mask", "to", "size"]
            )

    found = durable(first.mapInArrow(with_leaders, "band long, fp long, mask long, to array<long>, size long"))
    star = found.select("fp", F.explode("to").alias("b")).where("fp <> b")
    stars = star.select(F.least("fp", "b").alias("a"), F.greatest("fp", "b").alias("b"))

    @F.arrow_udf("long")
    def largest(groups: pa.Array) -> pa.Array:
        """Of masks with their numbers of members: the leaders of the component with most members, as bits."""
        out = []
        for rows in groups.to_pylist():
            parts: list[int] = []
            for r in rows:
                mask, rest = r["mask"], []
                for p in parts:
                    if p & mask:
                        mask |= p
                    else:
                        rest.append(p)
                parts = [*rest, mask] if mask else rest
            out.append(max(parts, key=lambda p: (sum(r["n"] for r in rows if r["mask"] & p), p), default=0))
        return pa.array(out, pa.int64())

    # 2**LEADERS masks of a band at most
    masks = found.groupBy("band", "mask").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    masks = masks.groupBy("band").agg(F.collect_list(F.struct("mask", "n")).alias("g"), F.sum("n").alias("n"), F.sum("size").alias("bytes"))
    main = durable(masks.select("band", "n", "bytes", largest("g").alias("main")))
    rows = spread_join(found.select("band", "fp", "mask", "size"), main.select("*", F.col("n").alias("all")), ["band"], total)
    seen = durable(rows.select("band", "fp", "size", "all", "bytes", (F.col("mask").bitwiseAND(F.col("main")) == 0).alias("outside")))
    out_n = seen.where("outside").groupBy("band").agg(F.count("*").alias("r"), F.sum("size").alias("rb"), F.first("all").alias("n"), F.first("bytes").alias("bytes"))
    tiles = lambda n, b: F.greatest(F.ceil(F.col(n) / TILE), F.ceil(F.col(b) / TILE_BYTES)).cast("int")
    out_n = durable(out_n.select("band", tiles("r", "rb").alias("ri"), tiles("n", "bytes").alias("nj"), "n"))
    if out_n.isEmpty():
        return stars
    sized = spread_join(seen.select("band", "fp", "outside"), out_n, ["band"], total)
    left = sized.where("outside").select("band", tile(F.col("ri")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"), F.lit(True).alias("left"), "fp")
    right = sized.select("band", F.explode(F.sequence(F.lit(0), F.col("ri") - 1)).alias("i"), tile(F.col("nj")).alias("j"), F.lit(False).alias("left"), "fp")
    dealt = left.unionByName(right).join(sketches, "fp").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").select("band", "i", "j", "left", "fp", *held)

    def run(batches):
        from .embeddings import _works

        for work in _works(batches, 3):
            a, fp = work.column("left").to_numpy(), work.column("fp").to_numpy()
            m = _matches(work, a, ~a) & (fp[a][:, None] != fp[~a][None, :])
            yield _edges([(fp[a][i], fp[~a][j]) for i, j in forest_between(m)])

    return stars.unionByName(dealt.mapInArrow(run, "a long, b long"))
