import random

import numpy as np

from blockloom.llm import similarity, simhash


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def made(seed=1, n=60):
    """Texts and copies of them with some words replaced."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows = []
    for i in range(n):
        base = [word() for _ in range(rng.choice([70, 200, 500]))]
        rows.append((10 * i, " ".join(base)))
        for c in range(1, 4):
            copy = list(base)
            for _ in range(rng.randrange(1, max(2, len(base) // 30))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((10 * i + c, " ".join(copy)))
    rng.shuffle(rows)
    return rows


def check(rows, root):
    """All pairs of 0.88 and more are together; no group holds a text that is alike to none of the others by 0.6."""
    sets = {i: shingles(t) for i, t in rows}
    ids = [i for i, _ in rows]
    near = {i: set() for i in ids}
    for a in ids:
        for b in ids:
            if a < b and a // 10 == b // 10:
                j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                if j >= 0.6:
                    near[a].add(b)
                    near[b].add(a)
                assert j < 0.88 or root[a] == root[b], (a, b, j)
    for a in ids:
        group = {b for b in ids if root[b] == root[a]} - {a}
        assert not group or group & near[a]
        assert all(b // 10 == a // 10 for b in group)


def test_pairs_of_high_similarity_meet(spark, monkeypatch):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    root = {r.doc_id: r.root for r in simhash.grouped(df, words=5, wide=True).collect()}
    check(rows, root)
    narrow = {r.doc_id: r.root for r in simhash.grouped(df, words=5).collect()}
    assert len(set(root.values())) < len(set(narrow.values()))
    monkeypatch.setattr(similarity, "TILE", 2)  # every shared band is hot
    assert {r.doc_id: r.root for r in simhash.grouped(df, words=5, wide=True).collect()} == root


def test_estimates():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.8, 0.95):
        got = []
        for _ in range(40):
            both = rng.integers(0, 2**63, int(1000 * share), dtype=np.uint64)
            rest = rng.integers(0, 2**63, (2, (1000 - len(both)) // 2), dtype=np.uint64)
            a, b = (similarity.minima(np.unique(np.concatenate((both, r)))) for r in rest)
            x, y = (np.frombuffer(similarity.sketch(v), "<u2") for v in (a, b))
            got.append((x == y).mean())
            if share >= 0.8:
                assert set(similarity.bands(a)) & set(similarity.bands(b))
        assert abs(np.mean(got) - share) < 0.02


def test_minima_continue():
    h = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64))
    assert (similarity.minima(h[3000:], similarity.minima(h[:3000])) == similarity.minima(h)).all()


def test_texts_without_words(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " "), (4, "a"), (5, "a"), (6, "b")], "doc_id long, text string")
    got = sorted(r.doc_id for r in simhash.deduplicate(df).collect())
    assert got == [1, 4, 6]
    assert simhash.deduplicate(df.where("doc_id < 4")).count() == 1


def test_pairs_at_the_border_are_decided_exactly(spark, monkeypatch):
    """Pairs of 0.80 and 0.81 link, pairs of 0.79 and 0.78 don't: each decided by the whole sets, in small groups and in split ones."""
    rng, rows, want = random.Random(9), [], {}
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    for k in range(120):
        base = [word() for _ in range((94, 99, 91, 87)[k % 4])]
        copy = list(base)
        copy[30], copy[60] = word(), word()
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        a, b = (shingles(t) for _, t in rows[-2:])
        x, y = (simhash.fingerprint(t, 5) for _, t in rows[-2:])
        want[k] = 5 * len(a & b) >= 4 * len(a | b) or (x ^ y).bit_count() <= 3
    assert 55 <= sum(want.values()) <= 65
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for tile in (similarity.TILE, 1):
        monkeypatch.setattr(similarity, "TILE", tile)
        root = {r.doc_id: r.root for r in simhash.grouped(df, words=5, wide=True).collect()}
        assert {k: root[2 * k] == root[2 * k + 1] for k in want} == want


def test_each_set_of_shingles_of_a_fingerprint_has_its_links(spark):
    """One repeated line makes the fingerprint of two texts; a third and a fourth are each like one of the two."""
    rng = random.Random(5)
    said = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(120))
    x, y, line = said(), said(), "one two three four five "
    rows = [(1, line * 400 + x), (2, line * 400 + y), (3, line + x), (4, line + y), (5, said())]
    fp = [simhash.fingerprint(t, 5) for _, t in rows]
    assert fp[0] == fp[1] and len(set(fp)) == 4
    df = spark.createDataFrame(rows, "doc_id long, text string")
    root = {r.doc_id: r.root for r in simhash.grouped(df, words=5, wide=True).collect()}
    assert root[1] == root[2] == root[3] == root[4] != root[5]


def test_bands_stay_together_under_the_adaptive_planner(spark):
    """Joins that turn into broadcasts at run time must not spread a band over tasks: all of many pairs are found."""
    rng, rows = random.Random(3), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    for k in range(900):
        base = [word() for _ in range(110)]
        rows.append((2 * k, " ".join(base)))
        if k % 3 == 0:
            base[50] = word()
            rows.append((2 * k + 1, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    root = {r.doc_id: r.root for r in simhash.grouped(df, words=5, wide=True).collect()}
    assert all((root[i] == root[i - 1]) for i in root if i % 2) and len(set(root.values())) == 900
