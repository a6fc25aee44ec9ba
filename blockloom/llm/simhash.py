"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits; bit i is set if more than half of the text's shingle hashes (XXH64, seed 42) have it. Two
fingerprints within DISTANCE = 3 bits differ in at most one bit of their upper or of their lower half. In each half,
anchors are the words of a covering code: 31 bits of a Hamming code, which covers with radius 1, and one free bit.
If two halves differ in at most one bit, an anchor within 1 of the one is within 2 of the other; so each distinct
fingerprint goes to all anchors within radius + 1 = 2 of each half (2 or 17 of them), and any two that can link meet.

Equal fingerprints are one class before anything is compared. An anchor's members are sorted and compared in tiles of
bounded size; each tile returns links that span its groups, never all pairs. Anchors with more than TILE members are
split: members are dealt to tiles by hash, and each pair of tiles is a task's work of its own.

Nulls are empty texts; texts without words have fingerprint zero and link like any other. Repeated ids: each row is
kept; their least id counts. Empty table: empty result. Other columns, whatever their names, are neither read nor
changed: deduplicate() returns them as they are, the others leave them out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import similarity
from .common import PARTS, col, durable, packed, session_of, spread_join, table
from .components import components
from .graphs import forest, forest_between

SEED, DISTANCE, TILE, SMALL = 42, 3, 4096, 8
_BLOCK = 1 << 16  # shingles whose bits are summed at once


def shingle_hashes(text: str, words: int) -> Iterator[np.ndarray]:
    """Hashes (uint64) of a text's shingles in order, repeats included, in blocks."""
    import xxhash

    parts = text.encode().lower().split()  # bytes: A-Z only, and space and \\x09-\\x0D
    if not parts:
        return
    joined = b" ".join(parts)
    ends = np.cumsum([len(x) + 1 for x in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(parts))
    starts, ends = starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist()
    of = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _BLOCK):
        yield np.array([of(joined[a:b], SEED) for a, b in zip(starts[at : at + _BLOCK], ends[at : at + _BLOCK], strict=True)], np.uint64)


def fingerprint(text: str, words: int = 3) -> int:
    """Unsigned 64 bits."""
    return _sketched(text, words, False)[0]


def distinct_hashes(text: str, words: int) -> np.ndarray:
    """A text's whole set of shingle hashes, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *map(np.unique, shingle_hashes(text, words))]))


def _sketched(text: str, words: int, wide: bool) -> tuple[int, int | None, list[int] | None, bytes | None, int | None]:
    """The fingerprint; if wide, a number for the set of shingles, bands, sketch and how many hashes the set has too (None without words)."""
    import xxhash

    counts, n, least, sets = np.zeros(64, np.int64), 0, None, []
    for h in shingle_hashes(text, words):
        n += len(h)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        if wide:
            sets.append(np.unique(h))
            least = similarity.minima(sets[-1], least)
    fp = int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")
    if least is None:
        return fp, None, None, None, None
    whole = sets[0] if len(sets) == 1 else np.unique(np.concatenate(sets))
    # the fingerprint counts repeats, the set doesn't: the number stands for both
    number = xxhash.xxh64_intdigest(whole.astype("<u8").tobytes(), fp) - (1 << 63)
    return fp, number, similarity.bands(least), similarity.sketch(least), len(whole)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, wide: bool = False) -> DataFrame:
    """doc_id, key (a hash of id and text), fp (the 64 bits as a signed long) for every row of docs; if wide, unit (a hash of fingerprint and set of shingles), bands, sketch and width (the set's size) too."""
    session_of(docs)
    slim = docs.select(col(doc_id).alias("doc_id"), _key(doc_id, text).alias("key"), F.coalesce(col(text), F.lit("")).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            got = [_sketched(t, words, wide) for t in batch.column("text").to_pylist()]
            cols = [batch.column("doc_id"), batch.column("key"), pa.array(np.array([g[0] for g in got], np.uint64).view(np.int64))]
            more = [pa.array([g[k] for g in got], t) for k, t in ((1, pa.int64()), (2, pa.list_(pa.int64())), (3, pa.binary()), (4, pa.int64()))] if wide else []
            yield pa.RecordBatch.from_arrays(cols + more, names=["doc_id", "key", "fp", "unit", "bands", "sketch", "width"][: len(cols) + len(more)])

    return slim.mapInArrow(run, f"doc_id {kind}, key long, fp long" + ", unit long, bands array<long>, sketch binary, width long" * wide)


def _hashed(near: DataFrame, docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """fp, sketch, hashes (the text's distinct shingle hashes, sorted, uint64). near: fp, id and key (of the text's row), sketch."""
    texts = docs.select(col(doc_id).alias("_id"), _key(doc_id, text).alias("key"), F.coalesce(col(text), F.lit("")).alias("text"))
    met = texts.join(near, (texts["key"] == near["key"]) & texts["_id"].eqNullSafe(near["id"])).select("fp", "sketch", "text")

    def run(batches):
        for batch in batches:
            seen, rows = set(), []
            for fp, sketch, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if fp not in seen:  # rows that agree in id and text
                    seen.add(fp)
                    rows.append((fp, sketch, distinct_hashes(t, words).astype("<u8").tobytes()))
            cols = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["fp", "sketch", "hashes"])

    return met.mapInArrow(run, "fp long, sketch binary, hashes binary")


def _key(doc_id: str, text: str):
    return F.xxhash64(col(doc_id), F.coalesce(col(text), F.lit("")))


def _masks() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome 0..31 the bits to flip for the code words within distance 2 of a 31-bit word: (32, 16) of them, and how many."""
    flips, n = np.zeros((32, 16), np.uint32), np.zeros(32, np.int64)
    for s in range(32):
        # position i (1..31) has syndrome i
        near = [0] if s == 0 else [1 << (s - 1)] + [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < i ^ s]
        flips[s, : len(near)], n[s] = near, len(near)
    return flips, n


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 32-bit words: (index of the word, anchor) for every anchor within 2."""
    flips, n = _masks()
    low, free = half & np.uint32(0x7FFFFFFF), half & np.uint32(0x80000000)
    syndrome = np.zeros(len(half), np.int64)
    for j in range(5):
        mask = np.uint32(sum(1 << (i - 1) for i in range(1, 32) if i >> j & 1))
        syndrome |= (np.bitwise_count(low & mask).astype(np.int64) & 1) << j
    who = np.repeat(np.arange(len(half)), n[syndrome])
    nth = np.arange(len(who)) - np.repeat(np.cumsum(n[syndrome]) - n[syndrome], n[syndrome])
    same = (low[who] ^ flips[syndrome[who], nth]) | free[who]
    # with the free bit flipped, one more bit is left: the nearest code word
    near = (low ^ flips[syndrome, 0]) | (free ^ np.uint32(0x80000000))
    return np.concatenate((who, np.arange(len(half)))), np.concatenate((same, near))


def _cover(classes: DataFrame) -> DataFrame:
    """anchor (upper bit: which half), fp."""

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for side in (0, 1):
                who, anchor = anchors((fp >> np.uint64(32 * side)).astype(np.uint32))
                yield pa.RecordBatch.from_arrays([pa.array((anchor.astype(np.int64) << 1) | side), pa.array(fp[who].view(np.int64))], names=["anchor", "fp"])

    return classes.select("fp").mapInArrow(run, "anchor long, fp long")


def close(x: np.ndarray, y: np.ndarray, most: int = DISTANCE) -> np.ndarray:
    """Boolean matrix: within most bits."""
    out = np.empty((len(x), len(y)), bool)
    step = max(1, (1 << 20) // max(1, len(y)))
    for at in range(0, len(x), step):
        out[at : at + step] = np.bitwise_count(x[at : at + step, None] ^ y[None, :]) <= most
    return out


def group_links(group: np.ndarray, tile: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (two arrays of fingerprints) that join all that belongs together within runs of equal group numbers.

    Small groups are compared all at once, each row with the ones up to SMALL - 1 after it; larger ones give a forest of
    their links, or of the links between their two tiles."""
    sizes = np.bincount(group)
    small = sizes[group] <= SMALL
    left, right = [], []
    for k in range(1, SMALL):
        i = np.flatnonzero((group[k:] == group[:-k]) & small[:-k])
        if not len(i):
            break
        near = np.bitwise_count(fp[i] ^ fp[i + k]) <= DISTANCE
        left.append(fp[i[near]])
        right.append(fp[i[near] + k])
    starts = np.cumsum(sizes) - sizes
    for g in np.flatnonzero(sizes > SMALL):
        rows = slice(starts[g], starts[g] + sizes[g])
        x, t = fp[rows], tile[rows]
        a = t == t[0]
        edges = forest(close(x, x)) if a.all() else forest_between(close(x[a], x[~a]))
        if edges:
            e = np.array(edges)
            left.append((x if a.all() else x[a])[e[:, 0]])
            right.append((x if a.all() else x[~a])[e[:, 1]])
    none = [fp[:0]]
    return np.concatenate(left or none), np.concatenate(right or none)


def _whole(batches, keys: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(group numbers, columns) of sorted batches; rows that agree in the first keys columns stay together over batch ends."""
    held: list[np.ndarray] = []

    def numbered(cols: list[np.ndarray]) -> np.ndarray:
        new = np.zeros(len(cols[0]), np.int64)
        for k in cols[:keys]:
            new[1:] |= k[1:] != k[:-1]
        return np.cumsum(new)

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cols = [np.concatenate((h, c)) for h, c in zip(held, cols, strict=True)] if held else cols
        if not len(cols[0]):
            continue
        group = numbered(cols)
        end = int(np.searchsorted(group, group[-1]))
        if end:
            yield group[:end], [c[:end] for c in cols]
        held = [c[end:] for c in cols]
    if held:
        yield numbered(held), held


def links(classes: DataFrame) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints (column fp)."""
    cover = _cover(classes)
    hot = durable(cover.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > TILE).select("anchor", F.ceil(F.col("n") / (TILE // 2)).cast("int").alias("tiles"), "n"))
    limit = max(TILE, classes.count() * 2 // PARTS)  # a fingerprint goes to two anchors at least
    # t1 <= t2: the pair of tiles; an anchor that isn't hot is the pair (0, 0)
    if hot.isEmpty():
        dealt = cover.select("anchor", F.lit(0).alias("t1"), F.lit(0).alias("t2"), F.lit(0).alias("t"), "fp")
    else:
        # rows of anchors with more than their share meet their tiles in place, the others after a shuffle
        very = F.broadcast(hot.where(F.col("n") > limit).drop("n"))
        calm = cover.join(very.select("anchor"), "anchor", "left_anti").join(hot.where(F.col("n") <= limit).drop("n"), "anchor", "left")
        dealt = cover.join(very, "anchor").unionByName(calm).withColumn("t", F.pmod(F.xxhash64("fp"), F.coalesce("tiles", F.lit(1))).cast("int"))
        dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1)))
        dealt = dealt.select("anchor", F.least("t", "o").alias("t1"), F.greatest("t", "o").alias("t2"), "t", "fp")
    dealt = dealt.repartition("anchor", "t1", "t2").sortWithinPartitions("anchor", "t1", "t2", "t", "fp")

    def run(batches):
        for group, (*_, tile, fp) in _whole(batches, 3):
            a, b = (x.view(np.int64) for x in group_links(group, tile, fp.view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, wide: bool = False) -> DataFrame:
    """doc_id, key, fp, root (its group's fingerprint), component_id (its group's least id) for every row of docs.

    wide: texts link as well if they share similarity.SIMILARITY of their shingles."""
    fps = durable(fingerprints(docs, doc_id, text, words, wide))
    # texts of one fingerprint are one class
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    classes = durable(classes.withColumn("node", 2 * F.monotonically_increasing_id()))
    edges = links(classes)
    if wide:
        # nodes are numbers of their own, even ones for fingerprints and odd ones for sets, so no two are equal by chance
        end = lambda c: classes.select(F.col("fp").alias(c), F.col("node").alias(f"{c}2"))
        edges = edges.join(end("a"), "a").join(end("b"), "b").select(F.col("a2").alias("a"), F.col("b2").alias("b"))
        # texts of one fingerprint may be of different shingles, and each set has links of its own
        units = fps.where("unit is not null").groupBy("unit", "fp").agg(F.min_by(F.struct("doc_id", "key", "bands", "sketch", "width"), F.struct("key", "doc_id")).alias("s"))
        units = units.join(classes.select("fp", F.col("node").alias("of")), "fp")
        units = durable(units.select((2 * F.monotonically_increasing_id() + 1).alias("fp"), "of", F.col("s.doc_id").alias("id"), "s.key", "s.bands", "s.sketch", "s.width"))
        candidates = components(similarity.links(units.select("fp", "bands", "sketch")))
        candidates = candidates.unionByName(candidates.select(F.col("root").alias("node"), "root").distinct())  # roots are no nodes there
        near = durable(units.join(candidates.select(F.col("node").alias("fp")), "fp").select("fp", "of", "id", "key", "sketch", "width"))
        found = similarity.confirmed(candidates, _hashed(near.select("fp", "id", "key", "sketch"), docs, doc_id, text, words), near.select("fp", "width"))
        # sets are nodes beside their fingerprints
        edges = edges.unionByName(found).unionByName(near.select(F.col("fp").alias("a"), F.col("of").alias("b")))
    else:
        classes = classes.withColumn("node", F.col("fp"))
    found = components(edges)
    rooted = durable(classes.join(found, "node", "left").select("fp", "least", "n", F.coalesce("root", "node").alias("at")))
    groups = rooted.groupBy("at").agg(F.min("fp").alias("root"), F.min("least").alias("component_id"), F.count("*").alias("classes"))
    named = spread_join(rooted, groups, ["at"], rooted.count(), "classes").select("fp", "root", "component_id", "n")
    return spread_join(fps, named, ["fp"], fps.count()).select("doc_id", "key", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least id reachable by links) for every row of docs."""
    return grouped(docs, doc_id, text, words).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5) -> DataFrame:
    """One row of docs of each group of texts alike by fingerprint or by 0.8 of their shingles: of its least id, ids before nulls; all columns."""
    groups = grouped(docs, doc_id, text, words, wide=True)
    kept = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "key")).alias("k"), F.count("*").alias("n"))
    kept = durable(kept.select(F.col("k.doc_id").alias("kept"), F.col("k.key").alias("kept_key"), "n"))
    own = docs.select(packed(docs), col(doc_id).alias("doc_id"), _key(doc_id, text).alias("key"))
    met = lambda rows: (rows["doc_id"].eqNullSafe(F.col("kept"))) & (rows["key"] == F.col("kept_key"))
    out = own.join(kept, met(own), "left_semi")
    # rows that agree in id and text are all met by that join: one of them stays
    again = groups.join(kept.where("n > 1"), met(groups), "left_semi").groupBy("doc_id", "key").count().where("count > 1")
    if not again.isEmpty():
        out = out.dropDuplicates(["doc_id", "key"])
    return out.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
