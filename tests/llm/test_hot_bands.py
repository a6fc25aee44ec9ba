"""Bands of very many members: leaders do most of the work, and what they leave apart is still compared."""

import numpy as np

from blockloom.llm import similarity


def made(seed=4):
    """A large group of near copies, a smaller one that shares a band with it, and some that only share the band."""
    rng = np.random.default_rng(seed)
    rows, truth = [], {}
    for group, n in ((0, 900), (1, 60)):
        base = rng.integers(0, 2**16, similarity.PERMUTATIONS).astype("<u2")
        for _ in range(n):
            v = base.copy()
            at = rng.random(similarity.PERMUTATIONS) < 0.06
            v[at] = rng.integers(0, 2**16, at.sum())
            rows.append(v)
            truth[len(rows) - 1] = group
    for _ in range(40):
        rows.append(rng.integers(0, 2**16, similarity.PERMUTATIONS).astype("<u2"))
        truth[len(rows) - 1] = len(rows)
    return rows, truth


def test_leaders_and_the_rest(spark, monkeypatch):
    from blockloom.llm.components import components

    rows, truth = made()
    fps = {k: (k * 7919) % 100_003 - 50_000 for k in truth}
    df = spark.createDataFrame([(fps[k], [1, 1000 + k % 2], r.tobytes()) for k, r in enumerate(rows)], "fp long, bands array<long>, sketch binary").repartition(6)
    for tile in (512, 100):
        monkeypatch.setattr(similarity, "TILE", tile)
        root = {r.node: r.root for r in components(similarity.links(df)).collect()}
        groups = {}
        for k, t in truth.items():
            groups.setdefault(t, set()).add(root.get(fps[k], fps[k]))
        assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)
