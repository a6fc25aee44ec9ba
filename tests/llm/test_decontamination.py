import random
from collections import Counter

import numpy as np

from blockloom.llm import decontamination as D


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_matches_plain_smith_waterman():
    rng = random.Random(1)
    items = [np.array([rng.randrange(6) for _ in range(rng.randrange(1, 25))]) for _ in range(120)]
    windows = [np.array([rng.randrange(-1, 6) for _ in range(rng.randrange(0, 40))], np.int64) for _ in range(120)]
    assert D.align(items, windows).tolist() == [smith_waterman(a, b) for a, b in zip(items, windows, strict=True)]


def corpus(seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["the", "of"] * 60
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(words(rng.randrange(15, 40)))) for k in range(30)]
    docs, want = [], set()
    for k in range(200):
        text = words(rng.randrange(0, 300))
        if k % 4 == 0:
            i, t = rng.choice(items)
            part = t.split()
            for _ in range(len(part) // 8 if k % 8 else 0):  # edits
                at = rng.randrange(len(part))
                part[at : at + rng.randrange(0, 2)] = [rng.choice(["edit", "the"])]
            at = rng.randrange(len(text) + 1)
            text[at:at] = part
            want.add((k, i))
        docs.append((k, " ".join(text).upper() if k % 3 else ", ".join(text)))
    return docs, items, want


def brute(docs, items):
    out = {}
    for d, t in docs:
        words = {}
        w = np.array([words.setdefault(x, len(words)) for x in D._WORD.findall((t or "").lower())])
        for i, q in items:
            v = np.array([words.setdefault(x, len(words)) for x in D._WORD.findall(q.lower())])
            if len(v) and (s := smith_waterman(v, w) / (2 * len(v))) >= (1 if len(v) < D.EXACT else D.THRESHOLD):
                out[d, i] = round(s, 6)
    return out


def test_finds_what_alignment_of_everything_finds(spark):
    docs, items, want = corpus()
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item string").repartition(4)
    i = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in D.contaminations(d, i).collect()}
    assert got == brute(docs, items) and want <= got.keys()
    kept = {r.doc_id for r in D.decontaminate(d, i).collect()}
    assert kept == {k for k, _ in docs} - {k for k, _ in got}


def test_blocks_and_pieces_give_the_same(spark, monkeypatch):
    docs, items, _ = corpus(3)
    items += [(100 + k, t) for k, t in enumerate(("w1 w2 w3", "the of the", "w7", "of w5 w6 w9 the w11"))]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, m string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    want = Counter(map(tuple, D.contaminations(d, i).collect()))
    kept = Counter(map(tuple, D.decontaminate(d, i).collect()))
    assert kept == Counter((*r, "x") for r in docs if r[0] not in {x[0] for x in want})
    for block, passes, postings in ((1000, 8, 1 << 22), (700, 2, 50), (1 << 22, 8, 7)):
        for name, v in (("BLOCK_BYTES", block), ("PASS", passes), ("POSTINGS", postings)):
            monkeypatch.setattr(D, name, v)
        assert Counter(map(tuple, D.contaminations(d, i).collect())) == want
        assert Counter(map(tuple, D.decontaminate(d, i).collect())) == kept


def recall(lo, hi, rate, n=120):
    """(found, to be found) of edited copies in texts of their own, by find() with the seeds that the corpus' counts give."""
    rng = random.Random(lo * 100 + int(rate * 100))
    vocabulary = [f"w{k}" for k in range(3000)]
    weights = [1 / (k + 3) for k in range(3000)]
    words = lambda k: rng.choices(vocabulary, weights, k=k)
    items, texts = [], []
    for k in range(n):
        item, copy = words(rng.randrange(lo, hi + 1)), []
        for w in item:
            kind = rng.random() / rate if rate else 9
            copy += words(1) if kind < 0.6 else [] if kind < 0.8 else [w, *words(1)] if kind < 1 else [w]
        items.append((k, " ".join(item)))
        texts.append(" ".join(words(20) + copy + words(20)))
    whole = D.build(items)
    docs = {n: np.zeros(len(k), np.int64) for n, k in whole.keys.items()}
    for t in texts:
        for g, k in docs.items():
            _, key = D._hits(D._batch([t], whole)[0], whole, g)
            k[np.unique(key)] += 1
    picked = []
    for w in whole.items:
        g, share, _ = D.rule(len(w))
        counts = docs[g][np.searchsorted(whole.keys[g], D._keys(w, g, len(whole.words) + 1)[1])]
        picked.append(D.rarest(counts, share))
    got = D.find(texts, D.build(items, only=picked))
    found = todo = 0
    for k, t in enumerate(texts):
        w = D._batch([t], whole)[0]
        floor = 1 if len(whole.items[k]) < D.EXACT else D.THRESHOLD
        if D.align([whole.items[k]], [w])[0] / (2 * len(whole.items[k])) >= floor:
            todo += 1
            found += k in {x[0] for x in got[k]}
    return found, todo


def test_recall_of_edited_copies():
    """Against alignment of whole texts, for items of 1 to 60 words with 0 to 40 % of their words edited."""
    for lo, hi in ((1, 4), (5, 8), (9, 11), (12, 20), (21, 29), (30, 60)):
        for rate in (0.0, 0.1, 0.2, 0.3, 0.4):
            found, todo = recall(lo, hi, rate)
            assert todo > 10 and found >= 0.98 * todo, (lo, hi, rate, found, todo)


def test_short_items_match_verbatim_only(spark):
    d = spark.createDataFrame([(1, "x Alpha, beta gamma DELTA y"), (2, "alpha beta gamma epsilon"), (3, "no word of it, but yes")], "doc_id long, text string")
    i = spark.createDataFrame([("a", "alpha beta gamma delta"), ("b", "Yes"), ("c", "--")], "item_id string, text string")
    assert {(r.doc_id, r.item_id, r.score) for r in D.contaminations(d, i).collect()} == {(1, "a", 1.0), (3, "b", 1.0)}
    assert D.contaminations(d, i, min_words=5).count() == 0


def test_a_passage_in_every_document_is_still_found(spark):
    """Seeds are the rarest n-grams of an item among its own, so an item that leaked everywhere keeps its seeds."""
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    d = spark.createDataFrame([(k, f"x{k} {item} y{k}") for k in range(300)], "doc_id long, text string")
    i = spark.createDataFrame([(1, item), (2, item), (3, "gammas"), (4, None), (5, "")], "item_id long, text string")
    got = Counter(r.item_id for r in D.contaminations(d, i).collect())
    assert got == {1: 300, 2: 300}


def test_nulls_and_empty_tables(spark):
    i = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    d = spark.createDataFrame([(1, None), (2, ""), (None, "one two three four five six"), (3, "!!")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id, r.score) for r in D.contaminations(d, i).collect()] == [(None, 1, 1.0)]
    assert D.contaminations(d.limit(0), i).count() == 0 and D.contaminations(d, i.limit(0)).count() == 0
    assert D.decontaminate(d, i.limit(0)).count() == 4 and D.decontaminate(d, i).count() == 3
