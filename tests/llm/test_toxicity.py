import random
import zlib

import numpy as np

from blockloom.llm import toxicity as T


def made(n=300, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(150)]
    rows = []
    for k in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 150))]
        if k % 5 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["zzuugh", "QQrrk", "zzuughy"])
        rows.append((k, " ".join(words), int(k % 5 == 0)))
    return rows


def test_learns_whole_texts():
    rows, new = made(), made(100, 2)
    net = T.fit([t for _, t, _ in rows], [y for *_, y in rows])
    s = net.scores([t for _, t, _ in new])
    y = np.array([y for *_, y in new])
    assert ((s >= T.PASSED) == y).mean() > 0.95
    clean = " ".join(t for _, t, y in new if not y)
    assert net.scores([clean + " zzuugh qqrrk zzuugh"])[0] > net.scores([clean])[0]  # the end of a long text is read


def test_gradients():
    rng = np.random.default_rng(0)
    p = {"word": np.zeros((1, T.WORD_DIM), np.float32), "char": np.zeros((T.TRIGRAMS, T.CHAR_DIM), np.float32)}
    d_in = T.WORD_DIM + T.CHAR_DIM
    init = lambda *s: rng.normal(0, 0.5, s)
    p |= {"v": init(2 * T.HIDDEN), "o": init(2 * T.HIDDEN), "c": init(1)}
    for s in "fb":
        p |= {"w" + s: init(d_in, 3 * T.HIDDEN), "b" + s: init(3 * T.HIDDEN), "u" + s: init(T.HIDDEN, 3 * T.HIDDEN)}
    net = T.Network({}, p)
    x = np.concatenate((np.zeros((1, d_in)), init(6, d_in)))
    ids = rng.integers(1, 7, (3, T.WINDOW))
    ids[1, 20:] = 0
    y, w = np.array([1.0, 0.0, 1.0]), np.array([0.3, 0.5, 0.2])

    def loss():
        px = np.concatenate((x @ p["wf"] + p["bf"], x @ p["wb"] + p["bb"]), 1)
        px[0] = 0
        z = net.forward(px[ids], (ids > 0).astype(np.float32)).astype(float)
        return float((w * (np.logaddexp(0, z) - y * z)).sum())

    g, dx = T._gradients(net, ids, x, y, w)
    for name in ("o", "v", "c", "wf", "ub", "bb", "uf"):
        for at in range(0, p[name].size, max(1, p[name].size // 5)):
            k = np.unravel_index(at, p[name].shape)
            old, step = p[name][k], 1e-2
            p[name][k] = old + step
            up = loss()
            p[name][k] = old - step
            down = loss()
            p[name][k] = old
            assert abs((up - down) / (2 * step) - g[name][k]) < 2e-3


def test_windows_cover_every_word():
    for n in (0, 1, 16, 17, 32, 33, 48, 49, 1000):
        seen = {k for s in T.windows(n) for k in range(s, min(n, s + T.WINDOW))}
        assert seen == set(range(n))


def test_long_runs_are_read_whole():
    rng = random.Random(8)
    for n in (1, 17, 32, 33, 34, 48, 2000):
        run = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
        words = T.words_of(run)
        assert max(map(len, words)) <= T.LONG and (n <= T.LONG) == (words == [run])
        assert {run[k : k + 3] for k in range(n - 2)} <= {w[k : k + 3] for w in words for k in range(len(w) - 2)}
        assert all(len(T.trigrams(w)) == len(w) for w in words)  # one for each character, the ends marked
    assert len(T.windows(len(T.words_of("x" * 2000)))) > 1


def test_frames(spark):
    rows = made(120, 3)
    df = spark.createDataFrame([(i, t, 0.0) for i, t, _ in rows] + [(900, None, 0.0), (901, "", 0.0), (902, "...", 0.0), (None, "a", 0.0), (0, rows[0][1], 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (900, None)], "doc_id long, toxic int")
    net = T.train(df, labels)
    got = T.score(df.repartition(3), net).collect()
    assert len(got) == 125 and {r.score for r in got if r.doc_id in (900, 901, 902)} == {0.0}
    assert all(0 <= r.score <= 1 for r in got)
    assert T.score(df, T.train(df, labels.limit(0))).count() == 125
    assert T.score(df.limit(0), net).count() == 0


def plain_score(net, text):
    """The network word by word and window by window, without batches or caches."""
    p, words = net.p, T.words_of(text)
    sig = lambda x: 1 / (1 + np.exp(-x))
    h0, logits = T.HIDDEN, []

    def vector(w):
        grams = T.trigrams(w)
        return np.concatenate((p["word"][net.words.get(w, 0)], sum(p["char"][g] for g in grams) / len(grams))).astype(float)

    for start in range(0, max(1, len(words) - T.WINDOW // 2), T.WINDOW // 2) if words else ():
        own = [vector(w) for w in words[start : start + T.WINDOW]]
        states = np.zeros((len(own), 2 * h0))
        for side, s in enumerate("fb"):
            h = np.zeros(h0)
            for t in range(len(own)) if s == "f" else reversed(range(len(own))):
                x, r = own[t] @ p["w" + s] + p["b" + s], h @ p["u" + s]
                z, reset = sig(x[:h0] + r[:h0]), sig(x[h0 : 2 * h0] + r[h0 : 2 * h0])
                h = (1 - z) * np.tanh(x[2 * h0 :] + reset * r[2 * h0 :]) + z * h
                states[t, h0 * side : h0 * (side + 1)] = h
        e = np.exp(states @ p["v"] - (states @ p["v"]).max())
        logits.append(float((e / e.sum()) @ states @ p["o"] + p["c"][0]))
    if not logits:
        return 0.0
    top = sorted(logits, reverse=True)[: T.TOP]
    top += [top[-1]] * (T.TOP - len(top))
    return sig(float(np.array([*np.clip(top, -20, 20), 1.0]) @ net.scale))


def test_scores_against_a_plain_loop(spark):
    rows = made(150, 4)
    net = T.fit([t for _, t, _ in rows], [y for *_, y in rows])
    texts = [t for _, t, _ in made(30, 5)] + ["", "...", "one", "word " * 31, "word " * 32, "word " * 33, "zzuugh " * 200, "漢字" * 120, "x" * 500 + " zzuugh", " ".join(t for _, t, _ in rows)]
    assert np.allclose(net.scores(texts), [plain_score(net, t) for t in texts], atol=1e-4)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(6)
    assert np.allclose([r.score for r in T.score(df, net).orderBy("doc_id").collect()], [plain_score(net, t) for t in texts], atol=1e-4)


def test_training_texts_without_words():
    net = T.fit(["", "...", "!", "?"], [1, 0, 0, 0])
    assert net.scores(["anything", ""]).tolist() == [0.25, 0.25]
    one = T.fit(["", "a word", "", "..."], [1, 0, 1, 0])  # only clean texts have words
    assert all(0 <= s <= 1 for s in one.scores(["a word", "", "other"]))


def test_very_long_texts_train_and_the_fit_is_the_same_for_any_partitions(spark):
    rows = made(60, 6)
    long = [k for k in range(0, 60, 5) if zlib.crc32(str(k).encode()) % 3 != 1][:2]
    for k in long:
        rows[k] = (k, rows[k][1] + " padding" * 20_000 + " zzuugh qqrrk", 1)  # over 64 KB
    df = spark.createDataFrame([(i, t, 0) for i, t, _ in rows] + [(5, "another text of an id", 1), (5, "and another", 1), (6, "x", 1)], "doc_id long, text string, y int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    a, b = T.train(df, labels), T.train(df.repartition(7), labels.repartition(4))
    assert a.words == b.words and all((a.p[k] == b.p[k]).all() for k in a.p) and "padding" in a.words
