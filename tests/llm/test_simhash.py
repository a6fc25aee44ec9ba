import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from blockloom.llm import simhash

SCHEMA = "doc_id long, text string, fp string"


def plain(text, words=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    parts = [w for w in text.split(" ") if w]
    if not parts:
        return 0
    k = min(words, len(parts))
    hs = [xxhash.xxh64_intdigest(" ".join(parts[i : i + k]).encode(), 42) for i in range(len(parts) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(ids, fps):
    root = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
    least = {}
    for i, r in enumerate(root):
        least[r] = min(least.get(r, ids[i]), ids[i])
    return [least[r] for r in root]


def result(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    return {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df, **more).collect()}


def test_matches_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "oNE"), (6, "É é"), (7, "a b"), (8, "a b c"), (9, "A\x0bB\x1cC d"), (10, "x " * 50_000)]
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([5, 80, 400]))]
        for c in range(3):
            copy = list(base)
            for _ in range(c):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((100 + 3 * i + c, " ".join(copy)))
    rng.shuffle(rows)
    fps = [plain(t or "") for _, t in rows]
    want = set(zip([i for i, _ in rows], [f"{f:016x}" for f in fps], brute([i for i, _ in rows], fps), strict=True))
    assert result(spark, rows) == want
    assert len({w[2] for w in want}) < len(rows) - 20


def test_fingerprint_of_one_shingle_is_its_hash(spark):
    t = "überall gleich viele"
    h = spark.range(1).select(F.xxhash64(F.lit(t))).first()[0]
    assert simhash.fingerprint(t) == h % 2**64 == plain(t)


def test_empty_table_and_repeated_rows(spark):
    assert result(spark, []) == set()
    df = spark.createDataFrame([(7, "a b c", "x"), (7, "a b c", "x")], SCHEMA)
    assert simhash.near_duplicates(df).count() == 2


def test_anchors_cover():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**32, 500, dtype=np.uint32)
    flip = np.uint32(1) << rng.integers(0, 32, 500).astype(np.uint32)
    for y in (x, x ^ flip):
        wx, ax = simhash.anchors(x)
        wy, ay = simhash.anchors(y)
        sx, sy = set(zip(wx.tolist(), ax.tolist(), strict=True)), set(zip(wy.tolist(), ay.tolist(), strict=True))
        assert {i for i, _ in sx & sy} == set(range(500))
    wx, ax = simhash.anchors(x)
    assert (np.bitwise_count(x[wx] ^ ax) <= 2).all()


def test_hot_anchors_are_split(spark, monkeypatch):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)} | {rng.getrandbits(64) for _ in range(100)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    from blockloom.llm.components import components

    for tile in (4096, 8):
        monkeypatch.setattr(simhash, "TILE", tile)
        found = {r.node % 2**64: r.root % 2**64 for r in components(simhash.links(df)).collect()}
        groups = {}
        for f, r in zip(fps, brute(list(range(len(fps))), fps), strict=True):
            groups.setdefault(r, set()).add(f)
        got = {}
        for f in fps:
            got.setdefault(found.get(f, f), set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))
