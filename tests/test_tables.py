"""Keyed tables: what an upsert writes, versions, failures, writers at once."""

import os
import random

import pytest
from pyspark.sql import functions as F

from blockloom.operators.tables import Conflict, KeyedTable


def make(spark, rows):
    return spark.createDataFrame(rows, "k long, v string, _pos int")


def rows(df):
    return sorted((r.k, r.v) for r in df.collect())


def buckets(folder):
    return {os.path.join(d, x) for d, ds, _ in os.walk(f"{folder}/data") for x in ds if x.startswith("_bucket=")}


def test_an_upsert_of_one_key_writes_one_bucket(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), ["k"], 8)
    assert t.read() is None and t.lookup(spark.range(3).withColumnRenamed("id", "k")) is None
    assert t.upsert(make(spark, [(k, f"a{k}", 0) for k in range(100)])) == 0
    before = buckets(tmp_path)
    assert len(before) == 8
    assert t.upsert(make(spark, [(7, "b", 0), (7, "c", 1)])) == 1
    assert len(buckets(tmp_path) - before) == 1
    want = sorted({**{k: f"a{k}" for k in range(100)}, 7: "c"}.items())
    assert rows(t.read()) == want and rows(t.read(0)) == [(k, f"a{k}") for k in range(100)]
    assert rows(t.lookup(spark.createDataFrame([(7,), (9,), (1000,)], "k long"))) == [(7, "c"), (9, "a9")]
    assert len(t.lookup(spark.createDataFrame([(7,)], "k long")).inputFiles()) < len(t.read().inputFiles())
    t.vacuum(1)
    assert rows(KeyedTable(spark, str(tmp_path), ["k"]).read()) == want and t.versions() == [1] and len(buckets(tmp_path)) == 8
    assert t.delete(spark.range(50).withColumnRenamed("id", "k")) == 2 and rows(t.read()) == want[50:]
    with pytest.raises(ValueError):
        KeyedTable(spark, str(tmp_path), ["v"])


def test_against_a_dict(spark, tmp_path):
    rng, want = random.Random(3), {}
    t = KeyedTable(spark, str(tmp_path), ["k"], 5)
    for n in range(4):
        batch = [(rng.randrange(30) if rng.random() < 0.95 else None, f"{n}-{i}", i) for i in range(40)]
        t.upsert(make(spark, [b for b in batch if b[0] is not None]))
        want |= {k: v for k, v, _ in batch if k is not None}
    assert rows(t.read()) == sorted(want.items())


def test_a_failed_write_leaves_the_last_version(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), ["k"], 4)
    t.upsert(make(spark, [(1, "a", 0)]))
    bad = make(spark, [(1, "b", 0)]).withColumn("v", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        t.upsert(bad)
    assert rows(t.read()) == [(1, "a")] and t.versions() == [0]
    assert t.upsert(make(spark, [(2, "c", 0)])) == 1 and rows(t.read()) == [(1, "a"), (2, "c")]


def test_two_writers_dont_lose_rows(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), ["k"], 4)
    t.upsert(make(spark, [(1, "a", 0)]))
    stale = t.manifest()
    t.upsert(make(spark, [(2, "b", 0)]))
    t.manifest = lambda version=None: stale  # a writer that read before the other committed
    with pytest.raises(Conflict):
        t.upsert(make(spark, [(3, "c", 0)]))
    del t.manifest
    open(tmp_path / "claims" / "000000002", "w").close()  # a writer that died
    with pytest.raises(Conflict):
        t.upsert(make(spark, [(3, "c", 0)]))
    os.utime(tmp_path / "claims" / "000000002", (1, 1))
    assert t.upsert(make(spark, [(3, "c", 0)])) == 2 and rows(t.read()) == [(1, "a"), (2, "b"), (3, "c")]


def test_many_rows_of_a_key_and_combined_columns(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "m"), ["k"], 4)
    t.upsert(make(spark, [(1, "a", 0), (1, "b", 1), (2, "c", 0)]), many=True)
    t.upsert(make(spark, [(1, "d", 0), (1, "e", 1)]), many=True)
    assert rows(t.read()) == [(1, "d"), (1, "e"), (2, "c")]
    c = KeyedTable(spark, str(tmp_path / "c"), ["k"], 4)
    more = {"v": lambda old, new: F.concat_ws(",", old, new)}
    for v in ("a", "b"):
        c.upsert(make(spark, [(1, v, 0)]), combine=more)
    assert rows(c.read()) == [(1, "a,b")]
    assert c.upsert(make(spark, [])) == 1 and rows(c.read()) == [(1, "a,b")]
    wide = spark.createDataFrame([(5, "x", 2.5)], "k long, v string, extra double")
    c.upsert(wide)
    assert {(r.k, r.extra) for r in c.read().collect()} == {(1, None), (5, 2.5)}
