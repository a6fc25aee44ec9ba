"""The chain against enumeration, features against plain n-grams, held-out and code-switched accuracy, odd texts."""

import itertools
import pickle

import numpy as np
import pytest

from blockloom.llm import language as L

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(spark, docs):
    return L.train(docs)


def enumerated(e, switch, first):
    """Probabilities of each word's languages, the log of the sum over all paths too."""
    n, k = e.shape
    out, total = np.zeros((n, k)), 0.0
    for path in itertools.product(range(k), repeat=n):
        p = np.exp(first[path[0]] + sum(e[t, c] for t, c in enumerate(path)) + sum(switch[a, b] for a, b in itertools.pairwise(path)))
        total += p
        out[np.arange(n), path] += p
    return out / total, np.log(total)


@pytest.mark.parametrize("block", [1, 2, 5, 64])
def test_marginals_are_those_of_all_paths(block):
    rng = np.random.default_rng(block)
    switch, first = rng.normal(size=(3, 3)), rng.normal(size=3)
    chains = [rng.normal(size=(n, 3)) * 2 for n in (1, 4, 6, 1, 7)]
    starts = np.concatenate([np.arange(len(c)) == 0 for c in chains])
    got = L.marginals(np.concatenate(chains), starts, switch, first, block)
    assert np.allclose(got, np.concatenate([enumerated(c, switch, first)[0] for c in chains]))


def test_gradients_are_those_of_the_likelihood():
    rng = np.random.default_rng(3)
    switch, first, e = rng.normal(size=(3, 3)), rng.normal(size=3), rng.normal(size=(2, 4, 3))
    y = np.array([[0, 2, 1, 1], [2, 0, -1, -1]])

    def likelihood(e, switch, first):
        out = 0.0
        for x, marks in zip(e, y, strict=True):
            m = marks[marks >= 0]
            out += first[m[0]] + x[np.arange(len(m)), m].sum() + sum(switch[a, b] for a, b in itertools.pairwise(m)) - enumerated(x[: len(m)], switch, first)[1]
        return out

    got = L._gradient(e, y, switch, first)
    for which, x in enumerate((e, switch, first)):
        want = np.zeros_like(x)
        for at in np.ndindex(x.shape):
            d = []
            for h in (1e-5, -1e-5):
                moved = [v.copy() for v in (e, switch, first)]
                moved[which][at] += h
                d.append(likelihood(*moved))
            want[at] = (d[0] - d[1]) / 2e-5
        assert np.allclose(got[which], want, atol=1e-6)


def test_features_are_ngrams_and_affixes():
    words = ["a", "straße", "中文字", "x" * 16]
    who, buckets = L.features(words)
    for k, w in enumerate(words):
        s = f"<{w}>"
        grams = [s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)] + [s[i : i + 4] for i in range(len(s) - 3) if i == 0 or i == len(s) - 4]
        assert (who == k).sum() == len(grams)
        assert sorted(buckets[who == k]) == sorted(L.features([w])[1])
    # equal n-grams share a bucket across words
    assert set(L.features(["xa"])[1]) & set(L.features(["xb"])[1])


def test_held_out_texts(spark, docs):
    got = {r.doc_id: r for r in L.query(spark, SF).collect()}
    rows = docs.select("doc_id", "lang").collect()
    assert sorted(got) == sorted(r.doc_id for r in rows)
    held = [got[r.doc_id].lang_pred == r.lang for r in rows if got[r.doc_id].held_out]
    assert np.mean(held) >= 0.98 and len(held) > 250


def test_code_switched_texts(model, docs):
    """Spans of held-out texts' parts, put together: nearly every word is of its part's language."""
    rows = [r for r in docs.where("crc32(cast(doc_id as string)) % 3 = 1").orderBy("doc_id").collect() if len(r.text) > 400]
    rng, good, total = np.random.default_rng(1), 0, 0
    for _ in range(60):
        parts = [(r.lang, " ".join(r.text.split()[5:17])) for r in (rows[i] for i in rng.integers(0, len(rows), 4))]
        text, truth = "", []
        for lang, t in parts:
            truth += [lang] * len(t)
            text += t
            truth.append(None)
            text += " "
        ((_, _, spans),) = L.labelled(model, [text], spans=True)
        assert all(a < b for _, a, b, _ in spans) and all(x[2] <= y[1] and x[0] != y[0] for x, y in itertools.pairwise(spans))
        for at, w in L.words_of(text):
            total += 1
            good += next(s[0] for s in spans if s[1] <= at < s[2]) == truth[at]
    assert good / total > 0.93


def test_odd_texts(spark, model, monkeypatch):
    texts = [None, "", " 12 _ %", "²Ⅷ 5", "der die das", "DER DIE DAS", "the" * 50_000, "中" * 100, "the of and " * 30_000, "ño"]
    df = spark.createDataFrame([(k if k else None, t, "lang") for k, t in enumerate(texts)], "doc_id long, text string, lang_pred string").repartition(3)
    got = {r.doc_id: r for r in L.identify(df, model, spans=True).collect()}
    assert len(got) == len(texts)
    assert all((got[k].lang_pred, got[k].score, got[k].spans) == ("und", 0.0, []) for k in (None, 1, 2, 3))
    assert [got[k].lang_pred for k in (4, 8)] == ["de", "en"] and got[8].spans == [("en", 0, len(texts[8]) - 1, 90_000)]
    assert all(0 < got[k].score <= 1 for k in range(4, 10))
    # chains that start anew within a text, a cache that is emptied, and a model that was sent
    whole = L.labelled(model, [t or "" for t in texts])
    for name, value in (("CHAIN", 7), ("GROUP", 20), ("CACHE", 3)):
        monkeypatch.setattr(L, name, value)
    again = L.labelled(pickle.loads(pickle.dumps(model)), [t or "" for t in texts[:6]])
    assert [x[:2] for x in again] == [x[:2] for x in whole[:6]]
    assert L.identify(df.limit(0), model).count() == 0


def test_few_languages(spark):
    rows = [(k, f"wort nummer {k} hier", "de") for k in range(9)]
    one = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in L.identify(one, L.train(one)).collect()} == {("de", 1.0)}
    none = spark.createDataFrame([(k, t, None) for k, t, _ in rows], one.schema)
    assert {(r.lang_pred, r.score) for r in L.identify(none, L.train(none)).collect()} == {("und", 0.0)}
    empty = one.withColumn("text", one.text.substr(1, 0))
    assert {r.lang_pred for r in L.identify(one, L.train(empty)).collect()} == {"und"}


def test_training_doesnt_depend_on_partitions(spark, docs):
    a, b = (L.train(docs.repartition(n).where("doc_id < 200"), most=60) for n in (1, 7))
    assert a.langs == b.langs and np.array_equal(a.weights, b.weights) and a.lexicon == b.lexicon
