"""One key of most rows, with limits so low that every way for hot keys and large tables is taken: equal results."""

import random

import numpy as np
from pyspark.sql import functions as F

from blockloom import joins
from blockloom.llm import mixing, sharding, similarity, simhash


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_spread_join(spark, monkeypatch):
    monkeypatch.setattr(joins, "FEW", 5)
    df = spark.range(3000).select(F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 200).alias("k"), "id")
    by = df.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    assert rows(joins.spread_join(df, by, ["k"], 3000).select("id", "m")) == rows(df.join(by, "k").select("id", "m"))


def test_sharding_of_equal_rows(spark, monkeypatch):
    made = [(None, "")] * 400 + [(1, "same text")] * 300 + [(k, f"text {k}") for k in range(300)]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    want = rows(sharding.shard(df, 60))
    monkeypatch.setattr(sharding, "BROADCAST_CELLS", 0)
    monkeypatch.setattr(sharding, "LEVEL_BITS", 2)
    monkeypatch.setattr(joins, "FEW", 5)
    assert rows(sharding.shard(df, 60)) == want


def test_mixing_of_a_hot_source(spark, monkeypatch):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.when(F.col("id") % 10 < 8, F.lit("hot")).when(F.col("id") % 10 == 8, None).otherwise(F.concat(F.lit("s"), F.col("id") % 70)).alias("source"))
    want = rows(mixing.mix(df))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    monkeypatch.setattr(joins, "FEW", 5)
    assert rows(mixing.mix(df)) == want


def test_anchors_of_most_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(6)
    low = rng.integers(0, 2**32, 1500, dtype=np.uint64)
    fps = np.unique(np.concatenate((low | np.uint64(7 << 40), low[:300] ^ np.uint64(1) | np.uint64(7 << 40), rng.integers(0, 2**63, 200, dtype=np.uint64))))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(4)
    from blockloom.llm.components import components

    want = rows(components(simhash.links(df)))
    monkeypatch.setattr(simhash, "TILE", 64)
    monkeypatch.setattr(simhash, "PARTS", 8)
    assert rows(components(simhash.links(df))) == want and len(want) >= 300


def test_groups_dealt_by_bytes(spark, monkeypatch):
    """Texts of one group, a few of them long: dealt by the size of their sets, they link as they do at once."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    made = []
    for g, (n, size) in enumerate(((40, 150), (6, 4000))):
        base = [word() for _ in range(size)]
        for k in range(n):
            copy = list(base)
            for _ in range(size // 60):
                copy[rng.randrange(size)] = word()
            made.append((100 * g + k, " ".join(copy)))
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    got = lambda: {r.doc_id: r.component_id for r in simhash.grouped(df, words=5, wide=True).collect()}
    want = got()
    monkeypatch.setattr(similarity, "TILE_BYTES", 8 * 4000)
    monkeypatch.setattr(similarity, "PARTS", 8)
    assert got() == want and len(set(want.values())) < len(made)
