import random
from collections import Counter, defaultdict

import pytest

from blockloom.llm import sharding
from tests.duck import connect

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("limit", [200, 2000, 10**9])
def test_agrees_with_sql_at_small_limits(spark, limit):
    rng = random.Random(limit)
    rows = [(k, rng.choice("abcdé") * rng.randrange(0, 90)) for k in range(400)] + [(401, "x" * 5000), (None, "n"), (402, None), (403, "")] + [(404, "same" * 9)] * 30
    df = frame(spark, rows).repartition(5)
    got = sharding.shard(df, limit).collect()
    con = connect()
    con.register("given", df.toPandas().astype({"doc_id": "Int64"}))
    want = con.sql(sharding.sql(limit, "given")).fetchall()
    key = lambda r: (-1 if r[0] is None or r[0] != r[0] else int(r[0]), r[1] or "", *r[5:])
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, want))


def test_every_shard_fits_and_nothing_is_lost(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LEVEL_BITS", 3)  # several rounds
    rows = [(k, "w" * (k % 50)) for k in range(1000)]
    got = sharding.shard(frame(spark, rows), 500).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    sizes = defaultdict(int)
    for r in got:
        sizes[r.shard] += len(r.text)
    assert max(sizes.values()) <= 500
    assert {r.shard: r.shard_bytes for r in got} == dict(sizes)
    assert not any(a != b and b.startswith(a) for a in sizes for b in sizes)


def test_later_rounds_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LEVEL_BITS", 3)
    rows = [(k, "w" * 10) for k in range(500)]
    want = {tuple(r) for r in sharding.shard(frame(spark, rows), 100).collect()}
    monkeypatch.setattr(sharding, "BROADCAST_CELLS", -1)
    assert {tuple(r) for r in sharding.shard(frame(spark, rows), 100).collect()} == want


def test_repeated_rows_are_paged(spark):
    rows = [(7, "abcd")] * 100 + [(k, "xy") for k in range(20)]
    got = sharding.shard(frame(spark, rows).repartition(4), 40).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    pages = defaultdict(int)
    for r in got:
        pages[r.shard] += len(r.text)
        assert not r.oversize
    assert max(pages.values()) <= 40 and sum(p.count("#") for p in pages) == 10
    assert all(r.shard_bytes == pages[r.shard] for r in got)


def test_empty_and_clashing_columns(spark):
    assert sharding.shard(frame(spark, [])).count() == 0
    names = "h b cell0 leaf leaf0 row at part off page here open lo hi depth prefix n _h _b _cell0 _leaf".split()
    rows = [(k, "abc" * (k % 9)) for k in range(200)] + [(7, "same" * 20)] * 20
    df = frame(spark, rows).selectExpr("*", "'old' as Shard", "1 as `dotted.name`", *(f"'{n}' as `{n}`" for n in names))
    got, plain = sharding.shard(df, 100), sharding.shard(frame(spark, rows), 100)
    assert got.columns == [*df.columns[:5], "dotted.name", *names, *sharding.ADDED]
    got = got.collect()
    assert all(r["dotted.name"] == 1 and all(r[n] == n for n in names) for r in got)
    key = lambda r: tuple(r[c] for c in plain.columns)
    assert Counter(map(key, got)) == Counter(map(key, plain.collect()))
