"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

Words are runs of letters and digits in lower case. An item's n-grams are counted over all documents; its seeds are the
rarest share of those that occur, ties kept. SEEDS gives n, the share and how many seeds must lie on nearby diagonals of a text, by
the item's length: short items have few n-grams, of which edits leave fewer still. Where that many do, the words around
them are aligned with the item by Smith-Waterman (match 2, mismatch -1, gap -1), unless they hold too few of its words
for any alignment to reach the threshold; the score is divided by that of a verbatim copy, so a copy has 1 and a copy
with edits or cuts has less. THRESHOLD and more is contamination; of items below EXACT words only verbatim copies are,
as half of three words is no evidence.

Items are taken in blocks of at most about BLOCK_BYTES, PASS blocks a pass. A pass reads all documents twice, once to
count and once to align; a worker holds one block's index at a time, so its memory has a bound whatever the benchmark's
size. Counts are always over all documents, so the result doesn't depend on the blocks. Seeds that very many items
share are taken in pieces of at most POSTINGS. Each text is treated alone: nothing is gathered by item, so a passage in
very many documents costs each of them its own alignment only.

Nulls and texts without words hold nothing and match nothing; items without words, or of fewer than min_words, match
nothing; equal items both match; repeated rows each have their matches. Empty tables: nothing is contaminated. Other
columns of docs, whatever their names, are neither read nor changed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, durable, session_of, table

MIN_WORDS, EXACT, THRESHOLD = 1, 5, 0.5
#: For items of under so many words: n, the share of their n-grams that are seeds, how many seeds a text must hold.
SEEDS = ((EXACT, 3, 1.0, 1), (12, 2, 1.0, 1), (30, 2, 0.75, 2), (1 << 62, 3, 0.75, 2))
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_BYTES, PASS, ITEM_BYTES = 4 << 20, 8, 16
POSTINGS = 1 << 22
_WORD = re.compile(r"\w+")
_CELLS, _SPACE = 1 << 19, 3  # _SPACE: words between two texts of a batch; no n-gram is longer


@dataclass
class Index:
    """One block of test items."""

    ids: list  # item ids
    words: dict[str, int]
    items: list[np.ndarray]  # word numbers
    keys: dict[int, np.ndarray]  # by n: sorted n-gram keys
    posts: dict[int, tuple[np.ndarray, np.ndarray]]  # by n: key's number x items + item, sorted; the offset in the item
    need: np.ndarray  # seeds that an item needs

    @property
    def size(self) -> int:
        return sum(map(len, self.keys.values()))


def rule(length: int) -> tuple[int, float, int]:
    """n, share and need of an item's length."""
    n, share, need = next(x[1:] for x in SEEDS if length < x[0])
    return min(n, length), share, need


def _keys(w: np.ndarray, n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, keys) of the n-grams of known words."""
    m = len(w) - n + 1
    if m < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ok = w[:m] >= 0
    for k in range(1, n):
        ok &= w[k : m + k] >= 0
    at = np.flatnonzero(ok)
    key = np.zeros(len(at), np.int64)
    for k in range(n):
        key = key * base + w[at + k]
    return at, key


def build(rows: list[tuple], min_words: int = MIN_WORDS, only: list[np.ndarray] | None = None) -> Index:
    """rows: (id, text). only: for each item, which of its n-grams are seeds; all else."""
    words: dict[str, int] = {}
    items, ids = [], []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1] or "")):
        w = _WORD.findall((text or "").lower())
        if len(w) >= max(1, min_words):
            ids.append(i)
            items.append(np.array([words.setdefault(x, len(words)) for x in w], np.int64))
    need, found = np.ones(len(items), np.int64), {}
    for k, w in enumerate(items):
        n, _, least = rule(len(w))
        at, key = _keys(w, n, len(words) + 1)
        if only is not None:
            at, key = at[only[k]], key[only[k]]
        need[k] = min(least, max(1, len(at)))
        found.setdefault(n, []).append((key, np.full(len(at), k, np.int64), at))
    keys, posts = {}, {}
    for n, parts in found.items():
        key, item, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        keys[n], number = np.unique(key, return_inverse=True)
        order = np.lexsort((at, item, number))
        posts[n] = number[order] * len(items) + item[order], at[order]
    return Index(ids, words, items, keys, posts, need)


def _batch(texts: list[str], index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts in a row (-1: in no item), a gap between texts; and where each text starts."""
    get, out, starts, at = index.words.get, [], [], 0
    gap = np.full(_SPACE, -1, np.int64)
    for t in texts:
        w = _WORD.findall(t.lower())
        starts.append(at)
        out += [np.fromiter((get(x, -1) for x in w), np.int64, len(w)), gap]
        at += len(w) + len(gap)
    return np.concatenate(out) if out else gap, np.array([*starts, at], np.int64)


def _hits(w: np.ndarray, index: Index, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in w, numbers of keys) of the block's n-grams."""
    at, key = _keys(w, n, len(index.words) + 1)
    if not len(at) or not len(index.keys[n]):
        return at[:0], at[:0]
    k = np.minimum(np.searchsorted(index.keys[n], key), len(index.keys[n]) - 1)
    ok = index.keys[n][k] == key
    return at[ok], k[ok]


def align(items: list[np.ndarray], windows: list[np.ndarray], least: np.ndarray | None = None) -> np.ndarray:
    """Smith-Waterman scores of item-window pairs, a batch of like sizes at a time. least: scores of interest; pairs that can't have theirs get 0."""
    out = np.zeros(len(items))
    order = sorted(range(len(items)), key=lambda k: (len(items[k]), len(windows[k])))
    at = 0
    while at < len(order):
        width = max(len(windows[k]) for k in order[at : at + 4096])
        part = order[at : at + max(1, min(4096, _CELLS // max(1, width)))]
        at += len(part)
        rows = max(len(items[k]) for k in part)
        x, y = np.full((len(part), rows), -2, np.int32), np.full((len(part), width), -1, np.int32)
        for r, k in enumerate(part):
            x[r, : len(items[k])], y[r, : len(windows[k])] = items[k], windows[k]
        if least is not None:
            # MATCH for each word of the item that the window holds at all is the most that there can be
            held = np.zeros(len(part), np.int32)
            for i in range(rows):
                held += (x[:, i : i + 1] == y).any(1)
            some = MATCH * held >= least[part]
            x, y, part = x[some], y[some], [k for k, s in zip(part, some.tolist(), strict=True) if s]
        h, best = np.zeros((len(part), width + 1), np.int32), np.zeros(len(part), np.int32)
        ramp = (-GAP * np.arange(width + 1)).astype(np.int32)
        for i in range(rows if part else 0):
            new = np.zeros_like(h)
            new[:, 1:] = np.maximum(h[:, :-1] + np.where(x[:, i : i + 1] == y, MATCH, MISMATCH).astype(np.int32), h[:, 1:] + GAP)
            np.maximum(new, 0, out=new)
            # gaps along the window: the best earlier cell less its distance
            h = np.maximum.accumulate(new + ramp, axis=1) - ramp
            np.maximum(best, h.max(1), out=best)
        out[part] = best
    return out


def _pieces(index: Index, hits: dict, docs: tuple[int, int], items: tuple[int, int]):
    """(document, item, diagonal) of all seeds of some documents and items, in pieces of at most POSTINGS; what belongs to a document and an item stays together."""
    spans, total, m = [], 0, len(index.items)
    for n, (at, k, doc) in hits.items():
        a, b = np.searchsorted(doc, docs)
        low, high = (np.searchsorted(index.posts[n][0], k[a:b] * m + x) for x in items)
        spans.append((n, at[a:b], doc[a:b], low, high - low))
        total += int((high - low).sum())
    for number, (lo, hi) in enumerate((docs, items)):
        if total > POSTINGS and hi - lo > 1:
            mid = (lo + hi) // 2
            for x in ((lo, mid), (mid, hi)):
                yield from _pieces(index, hits, *((x, items) if number == 0 else (docs, x)))
            return
    if total:
        out = []
        for n, at, doc, low, count in spans:
            post = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum()) if len(low) else low
            out.append((np.repeat(doc, count), index.posts[n][0][post] % m, np.repeat(at, count) - index.posts[n][1][post]))
        yield tuple(map(np.concatenate, zip(*out, strict=True)))


def find(texts: list[str], index: Index, threshold: float = THRESHOLD) -> list[list[tuple]]:
    """For each text (item number, score, first word) of items with the score and more, best place each."""
    out: list[list[tuple]] = [[] for _ in texts]
    if not index.items:
        return out
    w, starts = _batch(texts, index)
    hits = {}
    for n in index.keys:
        at, k = _hits(w, index, n)
        hits[n] = at, k, np.searchsorted(starts, at, "right") - 1
    length = np.array([len(x) for x in index.items])
    slack, floor = np.maximum(4, length // 3), np.where(length < EXACT, max(1.0, threshold), threshold)
    for doc, item, diagonal in _pieces(index, hits, (0, len(texts)), (0, len(index.items))):
        order = np.lexsort((diagonal, item, doc))
        doc, item, diagonal = doc[order], item[order], diagonal[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > slack[item[1:]])
        heads = np.flatnonzero(new)
        ends = np.append(heads[1:], len(doc))
        enough = ends - heads >= index.need[item[heads]]
        heads, ends = heads[enough], ends[enough]
        d, i = doc[heads], item[heads]
        low = np.maximum(diagonal[heads] - slack[i], starts[d])
        high = np.minimum(diagonal[ends - 1] + length[i] + slack[i], starts[d + 1] - _SPACE)
        first = np.maximum(diagonal[heads], low) - starts[d]
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for at in range(0, len(d), 1 << 14):
            part = slice(at, at + (1 << 14))
            whole = MATCH * length[i[part]]
            scores = align([index.items[k] for k in i[part]], [w[a:b] for a, b in zip(low[part], high[part], strict=True)], floor[i[part]] * whole) / whole
            for k in np.flatnonzero(scores >= floor[i[part]]).tolist():
                a, b, s = int(d[at + k]), int(i[at + k]), float(scores[k])
                if s > best.get((a, b), (0.0, 0))[0]:
                    best[a, b] = s, int(first[at + k])
        for (a, b), (s, p) in best.items():
            out[a].append((b, s, p))
    return [sorted(x) for x in out]


def blocks(items: DataFrame, item_id: str, text: str):
    """Lists of (id, text) of about BLOCK_BYTES at most."""
    slim = items.select(col(item_id).alias("id"), col(text).alias("text"))
    size = slim.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ITEM_BYTES).alias("b")).first()["b"] or 0
    n = int(size // BLOCK_BYTES) + 1
    for k in range(n):
        part = slim if n == 1 else slim.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield [tuple(r) for r in part.collect()]


def _held(sents: list):
    """The broadcast indexes with their numbers; of several, a worker lets go of each before it reads the next."""
    for b, sent in enumerate(sents):
        yield b, sent.value
        if len(sents) > 1 and hasattr(sent, "_value"):
            del sent._value  # read again from the worker's file by the next batch


def rarest(counts: np.ndarray, share: float) -> np.ndarray:
    """Which n-grams are seeds, from how many documents hold each: the rarest share of those that any document holds, ties kept.

    N-grams that none holds find nothing and don't count: of an edited copy they are the ones that the edits broke."""
    some = np.sort(counts[counts > 0])
    return counts <= some[int(np.ceil(share * len(some))) - 1] if len(some) else counts >= 0


def _seeds(texts: DataFrame, found: list[Index]) -> list[list[np.ndarray]]:
    """By block and item, which of its n-grams are the rarest over all texts (column text)."""
    context = texts.sparkSession.sparkContext
    sents = [context.broadcast(x) for x in found]

    def count(batches):
        totals: dict = {}
        for batch in batches:
            rows = batch.column("text").to_pylist()
            for b, own in _held(sents):
                w, starts = _batch(rows, own)
                for n, keys in own.keys.items():
                    at, key = _hits(w, own, n)
                    doc = np.searchsorted(starts, at, "right") - 1
                    pairs = np.unique(doc * len(keys) + key) if len(key) else key
                    k = totals.setdefault((b, n), np.zeros(len(keys), np.int64))
                    k += np.bincount(pairs % max(1, len(keys)), minlength=len(keys))
        for (b, n), k in totals.items():
            some = np.flatnonzero(k)
            for at in range(0, len(some), 1 << 16):
                s = some[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), b, np.int32)), pa.array(np.full(len(s), n, np.int32)), pa.array(s), pa.array(k[s])], names=["b", "n", "key", "docs"])

    # one row for each n-gram of the pass's items at most: figures of some 4 MB of text in PASS blocks
    rows = texts.mapInArrow(count, "b int, n int, key long, docs long").groupBy("b", "n", "key").agg(F.sum("docs").alias("docs")).toArrow()
    docs = {(b, n): np.zeros(len(k), np.int64) for b, x in enumerate(found) for n, k in x.keys.items()}
    at_b, at_n, key, number = (rows.column(c).to_numpy() for c in ("b", "n", "key", "docs"))
    for (b, n), k in docs.items():
        own = (at_b == b) & (at_n == n)
        k[key[own]] = number[own]
    out = []
    for b, index in enumerate(found):
        picked = []
        for w in index.items:
            n, share, _ = rule(len(w))
            _, keys = _keys(w, n, len(index.words) + 1)
            counts = docs[b, n][np.searchsorted(index.keys[n], keys)]
            picked.append(rarest(counts, share))
        out.append(picked)
    for sent in sents:
        sent.unpersist()
    return out


def matchers(docs: DataFrame, items: DataFrame, text: str, item_id: str, item_text: str, threshold: float, min_words: int) -> Iterator[tuple[Column, list]]:
    """For each pass a column ARRAY<STRUCT<item, score, word>> of docs' texts' matches, item being the id, and the broadcasts that it reads."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = session_of(docs)
    texts = docs.select(F.coalesce(col(text), F.lit("")).alias("text"))
    kind = items.select(col(item_id)).schema[0].dataType
    ddl = f"array<struct<item:{kind.simpleString()},score:double,word:bigint>>"
    arrow = pa.list_(pa.struct([("item", to_arrow_type(kind)), ("score", pa.float64()), ("word", pa.int64())]))
    todo = []

    def close() -> tuple[Column, list]:
        rows, found = zip(*todo, strict=True)
        picked = _seeds(texts, list(found))
        sents = [spark.sparkContext.broadcast(build(r, min_words, p)) for r, p in zip(rows, picked, strict=True)]  # of about BLOCK_BYTES each

        @F.arrow_udf(ddl)
        def matches(texts: pa.Array) -> pa.Array:
            rows = texts.to_pylist()
            got: list[list[dict]] = [[] for _ in rows]
            for _, index in _held(sents):
                for row, some in zip(got, find(rows, index, threshold), strict=True):
                    row += [{"item": index.ids[i], "score": round(s, 6), "word": p} for i, s, p in some]
            return pa.array(got, arrow)

        todo.clear()
        return matches(F.coalesce(col(text), F.lit(""))), sents

    for rows in blocks(items, item_id, item_text):
        index = build(rows, min_words)
        if index.size:
            todo.append((rows, index))
        if len(todo) == PASS:
            yield close()
    if todo:
        yield close()


def contaminations(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, item_id, score, word: one row for each item that a row of docs holds."""
    parts, held = [], []
    for c, sents in matchers(docs, items, text, item_id, item_text, threshold, min_words):
        if parts:  # of several passes each is written before the next, so executors hold the items of one
            parts[-1] = _written(parts[-1], held)
        held = sents
        parts.append(docs.select(col(doc_id).alias("doc_id"), F.explode(c).alias("m")).select("doc_id", F.col("m.item").alias("item_id"), "m.score", "m.word"))
    if not parts:
        kinds = (x.select(col(c)).schema[0].dataType.simpleString() for x, c in ((docs, doc_id), (items, item_id)))
        return docs.sparkSession.createDataFrame([], "doc_id {}, item_id {}, score double, word long".format(*kinds))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs that hold no item."""
    out, held = docs, []
    for c, sents in matchers(docs, items, text, item_id, item_text, threshold, min_words):
        if held:
            out = _written(out, held)
        out, held = out.where(F.size(c) == 0), sents
    return out


def _written(rows: DataFrame, sents: list) -> DataFrame:
    """A pass's rows, and its broadcasts gone."""
    out = durable(rows)
    for sent in sents:
        sent.destroy()
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
