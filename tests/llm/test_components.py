import random

import pytest

from blockloom.llm.components import components
from blockloom.llm.graphs import forest, forest_between


def brute(edges):
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = sorted((top(a), top(b)))
        root[q] = p
    return {x: top(x) for x in root if top(x) != x}


def graphs():
    rng = random.Random(5)
    chain = list(range(150))
    rng.shuffle(chain)
    yield "chain", list(zip(chain, chain[1:], strict=False))
    yield "star of the greatest", [(999, k) for k in range(300)]
    yield "star of the least", [(0, k) for k in range(1, 300)]
    yield "random", [(rng.randrange(400), rng.randrange(400)) for _ in range(250)]
    yield "dense", [(rng.randrange(40), rng.randrange(40)) for _ in range(600)]
    yield "tree", [(k, k // 2) for k in range(2, 200)]
    yield "negative", [(-5, 3), (3, -9), (2**62, -(2**62))]


@pytest.mark.parametrize(("name", "edges"), list(graphs()))
def test_components(spark, name, edges):
    df = spark.createDataFrame(edges + edges[:3], "a long, b long").repartition(3)
    assert {r.node: r.root for r in components(df).collect()} == brute([e for e in edges if e[0] != e[1]])


def test_no_edges(spark):
    df = spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")
    assert components(df).count() == 0 and components(df.limit(0)).columns == ["node", "root"]


def test_forests():
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (1, 2, 30):
        m = rng.random((n, n)) < 1.5 / n
        m |= m.T
        got, want = forest(m), [(i, j) for i in range(n) for j in range(i) if m[i, j]]
        assert all(m[i, j] for i, j in got) and brute(got) == brute(want) and len(got) <= n - 1
        r = rng.random((n, n + 3)) < 1.2 / n
        got, want = forest_between(r), [(i, j) for i in range(n) for j in range(n + 3) if r[i, j]]
        assert all(r[i, j] for i, j in got) and len(got) <= 2 * n + 2
        own = lambda e: brute([(i, 1000 + j) for i, j in e])
        assert own(got) == own(want)
