import math
import random
import re
import unicodedata

import numpy as np

from blockloom.llm import quality as Q

DOC = "doc_id long, text string, score string"


def docs(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(5, 80))]
        good = k % 3 > 0
        text = " ".join(words) + "." if good else [" ".join(w.upper() + "!!" for w in words), " ".join(w + "***" for w in words), " ".join([words[0]] * 40)][k % 9 // 3]
        out.append((k, text, int(good)))
    return out


def test_learns_and_scores_held_out_texts(spark):
    rows = docs()
    d = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], DOC).repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = Q.train(d, labels)
    got = {r.doc_id: r for r in Q.classify(d, model).collect()}
    wrong = [i for i, _, y in rows if got[i].predicted != y]
    assert len(wrong) <= 4 and dict(Q.classify(d, model).dtypes)["score"] == "double"
    assert 0 < len(model.rules) < 120
    assert Q.train(d.repartition(7), labels.repartition(3)) == model


def test_columns_agree_with_the_model(spark):
    d = spark.createDataFrame([(i, t, "x") for i, t, _ in docs(60, 2)], DOC)
    labels = spark.createDataFrame([(i, y) for i, _, y in docs(60, 2)], "doc_id long, quality int")
    model = Q.train(d, labels)
    rows = Q.statistics(d).select("row.doc_id", "q.*").orderBy("doc_id").collect()
    want = model(np.array([tuple(r)[1:] for r in rows], float))
    got = [r.score for r in Q.classify(d, model).orderBy("doc_id").collect()]
    assert np.allclose(want, got)


def test_held_out_labels_are_never_read(spark):
    import zlib

    rows = docs(200, 3)
    d = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], DOC)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    a = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    b = spark.createDataFrame([(i, 1 - y if held(i) else y) for i, _, y in rows], "doc_id long, quality int")
    assert Q.train(d, a) == Q.train(d, b)


def test_odd_texts_and_labels(spark):
    texts = [None, "", " ", "\n\n", "a", "|", "x " * 100_000]
    d = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, "n", "x"), (1, "", "x")], DOC)
    none = spark.createDataFrame([], "doc_id long, quality int")
    for labels in (none, spark.createDataFrame([(4, 1), (None, 0), (5, None)], "doc_id long, quality int")):
        got = Q.classify(d, Q.train(d, labels)).collect()
        assert len(got) == len(texts) + 2 and all(0 <= r.score <= 1 for r in got)
    assert Q.classify(d.limit(0), Q.train(d, none)).count() == 0


def plain_statistics(text):
    text = text or ""
    n, words, lines = len(text), [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w], [x for x in text.split("\n") if x]
    share = lambda a, b: a / b if b else 0.0
    of = lambda chars: sum(x in chars for x in text)
    return (
        math.log1p(len(words)), share(n, len(words)), share(math.log1p(len(set(words))), math.log1p(len(words))), share(sum(a == b for a, b in zip(words, words[1:], strict=False)), len(words)),
        share(sum(unicodedata.category(x) == "Lu" for x in text), n), share(of("0123456789"), n), share(of("*$#%&@^~<>{}[]=+_\\/"), n), share(of("!?"), n), share(of("|"), n), share(of(".,;:"), len(words)),
        share(n, len(lines)), share(len(set(lines)), len(lines)), share(sum(len(w) > 12 for w in words), len(words)), share(sum(len(w) < 4 for w in words), len(words)),
    )


def test_statistics_against_plain_python(spark):
    texts = [t for _, t, _ in docs(60, 5)] + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += [None, "", " \n\n ", "ÄÖÜ ÉÀ Ж abc", "a\u00a0b\tc\x0bd", "same\nsame\nother", "x" * 100_000, "😀 😀 !?", "[a]{b}<c> \\ / ^~", "| a | b |", "antidisestablishmentarianism it is"]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in Q.statistics(d).select("row.i", "q.*").collect()}
    for k, t in enumerate(texts):
        assert np.allclose(got[k], plain_statistics(t), rtol=1e-12), (t or "")[:60]


def test_labels_that_no_statistic_parts(spark):
    """Equal texts, or labels that don't depend on them: the score is the label's share."""
    d = spark.createDataFrame([(k, "one and the same text", "x") for k in range(60)], DOC)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    model = Q.train(d, labels)
    assert model.rules == () and all(0.2 < r.score < 0.8 for r in Q.classify(d, model).collect())


def test_clashing_columns(spark):
    names = ["row", "t", "w", "l", "n", "q", "id", "y", "o", "a.b"]
    d = spark.createDataFrame([(k, t, "old", *range(len(names))) for k, t, _ in docs(60, 6)], "doc_id long, text string, score string, " + ", ".join(f"`{n}` int" for n in names))
    labels = spark.createDataFrame([(i, y) for i, _, y in docs(60, 6)], "doc_id long, quality int")
    out = Q.classify(d, Q.train(d, labels))
    assert out.columns == ["doc_id", "text", *names, "score", "predicted"]
    assert all(tuple(r)[2:-2] == tuple(range(len(names))) for r in out.collect())
