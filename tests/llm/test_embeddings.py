import math

import numpy as np

from blockloom.llm import embeddings as E

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    ok = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n = len(rows)
    links = [set() for _ in range(n)]
    for i in range(n):
        for j in range(i):
            (a, u, x), (b, v, y) = rows[i], rows[j]
            if x is not None and x == y and ok(u) and ok(v) and len(u) == len(v):
                u, v = np.array(u, np.float32).astype(float), np.array(v, np.float32).astype(float)
                if u @ v / math.sqrt((u @ u) * (v @ v)) >= E.THRESHOLD:
                    links[i].add(j)
                    links[j].add(i)
    least = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in links[i]:
                if least[j] < least[i]:
                    least[i], changed = least[j], True
    return sorted((r[0], len(links[i]), least[i], r[0] == least[i]) for i, r in enumerate(rows))


def made(seed, n=160, dim=9):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = []
    for k in range(n):
        v = centres[rng.integers(12)] + rng.normal(size=dim) * rng.choice([0, 0.1, 0.3])
        rows.append((1000 - k, [float(np.float32(x)) for x in v * rng.choice([1, 1e-3, 50])], None if k % 17 == 0 else int(k % 3)))
    odd = [None, [], [0.0] * dim, [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0] * (dim + 1), [1.0] * (dim + 1), [-0.0] + [1.0] * (dim - 1), [0.0] + [1.0] * (dim - 1)]
    return rows + [(2000 + k, v, 1) for k, v in enumerate(odd)]


def result(spark, rows):
    return sorted(tuple(r) for r in E.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect())


def test_matches_brute_force(spark, monkeypatch):
    rows = made(1)
    want = brute(rows)
    assert result(spark, rows) == want
    for tile, block in ((7, 1 << 20), (5, 16), (100, 9)):
        monkeypatch.setattr(E, "TILE", tile)
        monkeypatch.setattr(E, "BLOCK", block)
        assert result(spark, rows) == want


def test_clashing_columns(spark):
    rows = made(2)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as l", "'y' as v", "0 as c", "1 as n", "2 as kept", "3 as component_id", "4 as root", "5 as blocks", "6 as dim")
    assert sorted(tuple(r) for r in E.near_vectors(df).collect()) == brute(rows)


def test_bounds_are_rigorous():
    rng = np.random.default_rng(5)
    for dim in (1, 2, 64, 1500):
        x = rng.normal(size=(60, dim)) * rng.choice([1, 1e-20, 1e20], (60, 1))
        y = x[:40] + rng.normal(size=(40, dim)) * np.abs(x[:40]) * 0.3
        cosine = (x / np.linalg.norm(x, axis=1)[:, None]) @ (y / np.linalg.norm(y, axis=1)[:, None]).T
        for t in (0.5, 0.93, 0.99):
            sure = np.abs(cosine - t) > 1e-12
            assert (E.linked(x, y, t) == (cosine >= t))[sure].all()
        q, s, e = E.quantise(x)
        assert q.dtype == np.int8
        u = x / np.linalg.norm(x, axis=1)[:, None]
        assert (np.abs(np.linalg.norm(u - s[:, None] * q, axis=1) - e) < 1e-9).all()


def test_copies_are_counted_not_compared(spark):
    rows = [(k, [1.0, 2.0, 3.0], 1) for k in range(500)] + [(600, [1.0, 2.0, 3.1], 1), (601, [1.0, 2.0, 3.0], 2), (3, [1.0, 2.0, 3.0], 1)]
    got = result(spark, rows)
    assert got == sorted([(k, 501, 0, k == 0) for k in range(500)] + [(600, 501, 0, False), (601, 0, 601, True), (3, 501, 0, False)])


def test_empty(spark):
    assert result(spark, []) == [] and len(result(spark, [(1, None, None)])) == 1
