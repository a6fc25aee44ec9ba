"""Language identification of words in code-switched text by a linear-chain conditional random field, in numpy.

A text's words are its runs of letters, very long ones in pieces. A word's features are its character n-grams (1 to 3, those
at its ends up to 4 with the end marked: its affixes), hashed, and the lexicons that hold it: a lexicon has the words that
mostly texts of one language hold. Weights of features, of transitions between languages and of the first word's language
are learnt together. Forward-backward gives each word's probabilities; a text's score for a language is their mean over its
words, and spans are runs of words of one likeliest language.

Training takes documents with a language that aren't held out: MAX_TEXTS at most in all, as many of each language, by least hash of
the id; of each, WINDOWS windows of SIZE words at most, spread over the whole text; of languages the MAX_LANGS with most
documents. Half of the training sequences are spliced from windows of different languages, so that the transitions
learn to switch. Lexicons are left out at random in training, as new texts have words that no lexicon holds.

The chain of a batch's texts is one array of words: a text's start is a transition that forgets what is before it. It is cut into
blocks of BLOCK words; the blocks' transfer matrices are multiplied side by side, the blocks are joined by their
vectors, and all words' probabilities follow side by side: exact, and in time linear in the words. A text is read CHAIN words at
a time, each such part a chain of its own, so memory is bounded whatever a text's length.

Nulls and texts without a letter are "und" with score 0; every input row gives one row; rows that agree in id each have
their own text's. Without labelled texts with words no language is learnt and all texts are "und"; of one language all texts with a letter have it.
Ties of languages go to the first by name, of sampled ids to the first text. Empty table: empty result. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, session_of, table

MAX_TEXTS, MAX_LANGS, WINDOWS, SIZE = 3000, 256, 8, 32
BUCKETS, AFFIX = 1 << 15, 4
HOLDS, MOSTLY = 2, 0.8  # a lexicon's word: in so many texts of its language at least, with such a share
STEPS, BATCH, RATE, DECAY, DROP, SPLICED, SEED = 150, 128, 0.05, 1e-4, 0.5, 0.5, 11
LONG, PIECE = 32, 16  # characters: of the longest word, of a longer run's pieces
BLOCK, CHAIN, CACHE, GROUP = 64, 1 << 16, 1 << 18, 1 << 17
NONE = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> Iterator[tuple[int, str]]:
    """(start, word) of each run of letters; runs of over LONG characters in pieces."""
    for m in _WORD.finditer(text):
        w, at = m[0], m.start()
        if len(w) <= LONG:
            yield at, w
        else:
            for k in range(0, len(w), PIECE):
                yield at + k, w[k : k + PIECE]


def is_word(w: str) -> bool:
    """Whether it has a letter; runs may be of numerals like the Roman ones alone."""
    return w.isalpha() or any(map(str.isalpha, w))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word's number, bucket) of all hashed features of words, which are in lower case and not empty."""
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    ends = np.cumsum(sizes)
    left, right = owner * 0, owner * 0  # characters before and after within the word
    at = np.arange(len(codes))
    left, right = at - (ends - sizes)[owner], ends[owner] - 1 - at
    who, out, h = [], [], np.zeros(len(codes), np.uint64)
    for n in range(1, AFFIX + 1):
        h = (h[: len(codes) - n + 1] ^ codes[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        inside = right[: len(h)] >= n - 1
        if n == AFFIX:  # only those at an end
            inside &= (left[: len(h)] == 0) | (right[: len(h)] == n - 1)
        who.append(owner[: len(h)][inside])
        out.append((h[inside] >> np.uint64(40)).astype(np.int64) % BUCKETS)
    return np.concatenate(who), np.concatenate(out)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (BUCKETS, languages)
    lexicon: dict[str, int]  # word -> number of its language
    listed: np.ndarray  # (languages, languages): of words of a lexicon
    switch: np.ndarray  # (languages, languages)
    first: np.ndarray
    cache: dict[str, int] = field(default_factory=dict)
    rows: np.ndarray | None = None

    def emissions(self, words: list[str]) -> np.ndarray:
        """(words, languages), of words with a letter, in lower case."""
        who, buckets = features(words)
        out = np.stack([np.bincount(who, self.weights[buckets, k], len(words)) for k in range(len(self.langs))], 1)
        for k, w in enumerate(words):
            if (lang := self.lexicon.get(w)) is not None:
                out[k] += self.listed[lang]
        return out

    def numbered(self, words: list[str]) -> np.ndarray:
        """Rows of self.rows for words as they stand in texts; -1 for those without a letter. Keeps CACHE words."""
        if len(self.cache) > CACHE:
            self.cache, self.rows = {}, None
        cache = self.cache
        new = {w: None for w in words if w not in cache}
        if new:
            letters = [w for w in new if is_word(w)]
            for w in new:
                cache[w] = -1
            start = 0 if self.rows is None else len(self.rows)
            if letters:
                got = self.emissions([w.lower() for w in letters])
                self.rows = got if self.rows is None else np.concatenate((self.rows, got))
                cache.update(zip(letters, range(start, start + len(letters)), strict=True))
        return np.fromiter(map(cache.__getitem__, words), np.int64, len(words))


def marginals(emissions: np.ndarray, starts: np.ndarray, switch: np.ndarray, first: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Each word's probabilities, for chains one after the other; starts: whether a word is the first of its chain (the first row is)."""
    n, k = emissions.shape
    if not n:
        return emissions
    blocks = -(-n // block)
    x, new = np.ones((blocks * block, k)), np.ones(blocks * block, bool)  # what is added are chains of one word
    x[:n], new[:n] = np.exp(emissions - emissions.max(1, keepdims=True)), starts
    a, s = np.exp(switch - switch.max()), np.exp(first - first.max())
    x, new = np.ascontiguousarray(x.reshape(blocks, block, k).transpose(1, 0, 2)), new.reshape(blocks, block).T
    p = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for t in range(block):  # the product of a block's transfer matrices
        step = (p.reshape(-1, k) @ a).reshape(p.shape)
        if new[t].any():
            step[new[t]] = p[new[t]].sum(2, keepdims=True) * s
        p = step * x[t][:, None, :]
        p /= p.sum((1, 2), keepdims=True)
    left, right = np.empty((blocks, k)), np.empty((blocks, k))
    v = np.full(k, 1.0 / k)
    for b in range(blocks):
        left[b] = v
        v = v @ p[b]
        v /= v.sum()
    v = np.full(k, 1.0 / k)
    for b in range(blocks - 1, -1, -1):
        right[b] = v
        v = p[b] @ v
        v /= v.sum()
    out = np.empty((block, blocks, k))
    for t in range(block):
        left = np.where(new[t][:, None], s, left @ a) * x[t]
        left /= left.sum(1, keepdims=True)
        out[t] = left
    for t in range(block - 1, -1, -1):
        out[t] *= right
        seen = x[t] * right
        right = np.where(new[t][:, None], 1.0, seen @ a.T)
        right /= right.sum(1, keepdims=True)
    out /= out.sum(2, keepdims=True)
    return out.transpose(1, 0, 2).reshape(-1, k)[:n]


def _gradient(e: np.ndarray, y: np.ndarray, switch: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the log likelihood of labels y (sequences, SIZE; -1 after a sequence's end): by emissions, switch, first."""
    b, t_max, k = e.shape
    live = y >= 0
    x = np.where(live[:, :, None], np.exp(e - e.max(2, keepdims=True)), 1.0)
    a = np.exp(switch)
    alpha, norm, beta = np.empty_like(x), np.ones((b, t_max)), np.ones_like(x)
    for t in range(t_max):
        v = (np.exp(first) if t == 0 else alpha[:, t - 1] @ a) * x[:, t]
        norm[:, t] = v.sum(1)
        alpha[:, t] = v / norm[:, t : t + 1]
    for t in range(t_max - 2, -1, -1):
        ahead = (x[:, t + 1] * beta[:, t + 1]) @ a.T / norm[:, t + 1 : t + 2]
        beta[:, t] = np.where(live[:, t + 1, None], ahead, 1.0)
    gamma = alpha * beta
    gamma /= gamma.sum(2, keepdims=True)
    hot = np.eye(k)[np.maximum(y, 0)] * live[:, :, None]
    d = hot - gamma * live[:, :, None]
    pairs = live[:, 1:]
    after = x[:, 1:] * beta[:, 1:] / norm[:, 1:, None]
    joint = np.einsum("bti,btj,bt->ij", alpha[:, :-1], after, pairs.astype(float)) * a
    seen = np.einsum("bti,btj->ij", hot[:, :-1], hot[:, 1:])
    return d, seen - joint, d[:, 0].sum(0)


def fit(windows: list[tuple[str, int, list[str]]]) -> Model:
    """windows: (language, text's number, words with a letter). Any order of windows of one text gives the same model if texts are in order."""
    langs = sorted({lang for lang, _, ws in windows if ws})
    k, number = len(langs), {lang: i for i, lang in enumerate(langs)}
    rng = np.random.default_rng(SEED)
    own = [(number[lang], text, [w.lower() for w in ws]) for lang, text, ws in windows if ws]
    model = Model(langs, np.zeros((BUCKETS, max(1, k))), {}, np.zeros((k, k)), np.zeros((k, k)), np.zeros(k))
    if k < 2:
        return model
    held: list[dict[str, set[int]]] = [{} for _ in langs]
    for lang, text, ws in own:
        for w in ws:
            held[lang].setdefault(w, set()).add(text)
    texts = [max(1, len({t for lang, t, _ in own if lang == i})) for i in range(k)]
    share: dict[str, np.ndarray] = {}
    for i, words in enumerate(held):
        for w, ts in words.items():
            share.setdefault(w, np.zeros(k))[i] = len(ts) / texts[i]
    for w, v in share.items():
        best = int(v.argmax())
        if len(held[best][w]) >= HOLDS and v[best] >= MOSTLY * v.sum():
            model.lexicon[w] = best
    by_lang = [[ws for lang, _, ws in own if lang == i] for i in range(k)]
    params = {"weights": model.weights, "listed": model.listed, "switch": model.switch, "first": model.first}
    moments = {n: (np.zeros_like(v), np.zeros_like(v)) for n, v in params.items()}
    for step in range(1, STEPS + 1):
        vocabulary: dict[str, int] = {}
        ids, y = np.zeros((BATCH, SIZE), np.int64), np.full((BATCH, SIZE), -1)
        for r in range(BATCH):
            i = int(rng.integers(k))
            ws = by_lang[i][rng.integers(len(by_lang[i]))]
            marks = [i] * len(ws)
            if rng.random() < SPLICED:
                j = (i + 1 + int(rng.integers(k - 1))) % k
                other = by_lang[j][rng.integers(len(by_lang[j]))]
                # a part of the one within, before or after the other
                a, b = sorted(rng.integers(0, SIZE + 1, 2).tolist())
                ws, marks = ws[:a] + other[a:b] + ws[b:], [i] * len(ws[:a]) + [j] * len(other[a:b]) + [i] * len(ws[b:])
            ids[r, : len(ws)] = [vocabulary.setdefault(w, len(vocabulary)) for w in ws]
            y[r, : len(ws)] = marks
        names = list(vocabulary)
        who, buckets = features(names)
        lex = np.array([model.lexicon.get(w, -1) if rng.random() >= DROP else -1 for w in names])
        e = np.stack([np.bincount(who, model.weights[buckets, c], len(names)) for c in range(k)], 1)
        e[lex >= 0] += model.listed[lex[lex >= 0]]
        d, d_switch, d_first = _gradient(e[ids], y, model.switch, model.first)
        flat, at = d.reshape(-1, k), ids.reshape(-1)
        by_word = np.stack([np.bincount(at, flat[:, c], len(names)) for c in range(k)], 1)
        g_listed = np.zeros((k, k))
        np.add.at(g_listed, lex[lex >= 0], by_word[lex >= 0])
        grads = {
            "weights": np.stack([np.bincount(buckets, by_word[who, c], BUCKETS) for c in range(k)], 1),
            "listed": g_listed,
            "switch": d_switch,
            "first": d_first,
        }
        pace = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for n, g in grads.items():
            g = g / BATCH - DECAY * params[n]
            m, s = moments[n]
            m += 0.1 * (g - m)
            s += 0.02 * (g * g - s)
            params[n] += pace * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.98**step)) + 1e-8)
    return model


def sampled(text: str) -> list[list[str]]:
    """WINDOWS windows of SIZE words with a letter at most, spread over the whole text."""
    words = [w for _, w in words_of(text) if is_word(w)]
    if len(words) <= SIZE:
        return [words] if words else []
    starts = sorted({int(x) for x in np.linspace(0, len(words) - SIZE, WINDOWS)})
    return [words[s : s + SIZE] for s in starts]


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", modulus: int = 3, held: int = 1, most: int = MAX_TEXTS) -> Model:
    """most: texts of the sample at most."""
    session_of(docs)
    key = F.coalesce(col(doc_id).cast("string"), F.lit(""))
    rows = docs.where(col(lang).isNotNull() & (F.pmod(F.crc32(key), F.lit(modulus)) != held))
    rows = rows.select(F.md5(key).alias("o"), col(lang).cast("string").alias("lang"), F.coalesce(col(text), F.lit("")).alias("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()}
    each = max(1, most // max(1, len(sizes)))
    if not sizes:
        return fit([])
    # about twice as many as needed by hash, then the first of these: no language's rows go to one task
    part = docs.sparkSession.createDataFrame([(x, min(1.0, 2 * each / n)) for x, n in sizes.items()], "lang string, part double")
    uniform = F.conv(F.substring("o", 1, 13), 16, 10).cast("double") / float(1 << 52)
    some = rows.join(F.broadcast(part), "lang").where(uniform < F.col("part"))  # MAX_LANGS rows
    first = some.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("o", "text"))).where(F.col("k") <= each).select("lang", "o", "k", "text")

    def run(batches):
        for batch in batches:
            out = [(x, o, k, w) for x, o, k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for w in sampled(t)]
            cols = zip(*out, strict=True) if out else ((),) * 4
            types = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["lang", "o", "k", "words"])

    got = first.mapInArrow(run, "lang string, o string, k int, words array<string>").collect()  # MAX_TEXTS * WINDOWS * SIZE words at most
    got.sort(key=lambda r: (r["lang"], r["k"], r["words"]))
    texts = {x: i for i, x in enumerate(dict.fromkeys((r["lang"], r["k"]) for r in got))}
    return fit([(r["lang"], texts[r["lang"], r["k"]], r["words"]) for r in got])


def _chains(texts: list[str]) -> Iterator[tuple[int, list[int], list[str]]]:
    """(text's number, starts, words), CHAIN words at most at a time."""
    for i, t in enumerate(texts):
        words = words_of(t)
        while part := list(islice(words, CHAIN)):
            yield i, [a for a, _ in part], [w for _, w in part]


def labelled(model: Model, texts: list[str], spans: bool = False) -> list[tuple[str, float, list[tuple[str, int, int, int]]]]:
    """For each text its language, the score, and if spans the runs (language, start, end, words) of its words."""
    k = len(model.langs)
    sums, runs = np.zeros((len(texts), max(1, k))), [[] for _ in texts]
    chains = _chains(texts) if k else iter(())
    while True:
        group, held = [], 0
        while held < GROUP and (chain := next(chains, None)):
            group.append(chain)
            held += len(chain[2])
        if not group:
            break
        ids = model.numbered([w for _, _, ws in group for w in ws])
        owner = np.repeat([i for i, _, _ in group], [len(ws) for _, _, ws in group])
        chain = np.repeat(np.arange(len(group)), [len(ws) for _, _, ws in group])
        ok = ids >= 0
        ids, owner, chain = ids[ok], owner[ok], chain[ok]
        if not len(ids):
            continue
        new = np.ones(len(ids), bool)
        new[1:] = chain[1:] != chain[:-1]
        p = marginals(model.rows[ids], new, model.switch, model.first) if k > 1 else np.ones((len(ids), 1))
        for c in range(k):
            sums[:, c] += np.bincount(owner, p[:, c], len(texts))
        if spans:
            where = np.array([a for _, starts, _ in group for a in starts])[ok]
            ends = where + np.array([len(w) for _, _, ws in group for w in ws])[ok]
            best = p.argmax(1)
            cut = np.flatnonzero(np.concatenate(([True], (best[1:] != best[:-1]) | (owner[1:] != owner[:-1]), [True])))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                mine, last = runs[owner[a]], model.langs[best[a]]
                if mine and mine[-1][0] == last:  # a chain's start within a text
                    mine[-1] = (last, mine[-1][1], int(ends[b - 1]), mine[-1][3] + b - a)
                else:
                    mine.append((last, int(where[a]), int(ends[b - 1]), b - a))
    total = sums.sum(1)
    return [(model.langs[int(v.argmax())], round(min(1.0, float(v.max() / t)), 6), r) if t > 0 else (NONE, 0.0, r) for v, t, r in zip(sums, total, runs, strict=True)]


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs; if spans, also spans: the runs of words of one language, in code points."""
    session_of(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by BUCKETS, MAX_LANGS and the sample's words
    slim = docs.select(col(doc_id).alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    item = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())]))

    def run(batches):
        for batch in batches:
            got = labelled(sent.value, batch.column("text").to_pylist(), spans)
            cols = [batch.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            if spans:
                cols.append(pa.array([[dict(zip(("lang", "start", "end", "words"), x, strict=True)) for x in g[2]] for g in got], item))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang_pred", "score", "spans"][: len(cols)])

    more = ", spans array<struct<lang:string,start:bigint,end:bigint,words:bigint>>" if spans else ""
    return slim.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double{more}")


def lexicons(model: Model) -> Counter:
    """How many words each language's lexicon has."""
    return Counter(model.langs[i] for i in model.lexicon.values())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3)) == 1
    return identify(docs, train(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
