import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from blockloom.operators.tables import KeyedTable
from blockloom.streaming import incremental, streams
from blockloom.streaming.streams import Breaker
from tests.duck import SF


def test_breaker():
    b = Breaker(2, 10)
    for at, ok, state in ((0, False, "closed"), (1, False, "open"), (2, True, "open"), (11, False, "open"), (12, True, "open"), (21, True, "closed"), (22, False, "closed"), (40, False, "closed"), (41, True, "closed")):
        b.call(at, ok)
        assert b.state == state, at
    assert b.failures == 0 and b.rejected == 2
    b = Breaker(3, 10)
    for at in (0, 1, 20):
        b.call(at, False)
    assert (b.failures, b.state) == (1, "closed")


def test_chunks_composed_are_the_breaker(spark, monkeypatch):
    """Dense and sparse users, one of most events, in chunks of few events: what one breaker makes of them in order."""
    rng = random.Random(5)
    rows, at = [], dict.fromkeys(range(6), 0)
    for k in range(3000):
        u = 0 if rng.random() < 0.7 else rng.randrange(6)
        at[u] += rng.choice((0, 1, 3, 900, 4000)) if u else rng.choice((0, 20, 400, 1200))
        rows.append((k, datetime(2024, 1, 1) + timedelta(seconds=at[u]), u, "error" if rng.random() < (0.6 if u % 2 else 0.35) else "view"))
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").repartition(3)
    for threshold, reset in ((3, 3600.0), (1, 60.0), (2, 10_000.0)):
        want = {}
        for k, ts, u, kind in sorted(rows, key=lambda r: (r[1], r[0])):
            want.setdefault(u, Breaker(threshold, reset)).call(ts.timestamp(), kind != "error")
        want = {u: (b.failures, b.state, b.rejected) for u, b in want.items()}
        for size in (streams.CHUNK_ROWS, 150):
            monkeypatch.setattr(streams, "CHUNK_ROWS", size)
            assert {r.user_id: (r.n_failures, r.state, r.n_rejected) for r in streams.breaker_table(df, threshold, reset).collect()} == want
        monkeypatch.undo()


def test_breaker_table_and_stream_agree(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    want = {}
    for r in events.orderBy("ts", "event_id").collect():
        want.setdefault(r.user_id, Breaker()).call(r.ts.timestamp(), r.event_type != "error")
    want = {u: (b.failures, b.state, b.rejected) for u, b in want.items()}
    assert {r.user_id: (r.n_failures, r.state, r.n_rejected) for r in streams.breaker_table(events).collect()} == want
    out = streams.drained(streams.breaker_stream(streams.event_stream(spark, SF)), "update", ("user_id",)).collect()
    assert {r.user_id: (r.n_failures, r.state, r.n_rejected) for r in out} == want


def test_ingest_merges_each_file_once(spark, tmp_path):
    inbox, table, mark = tmp_path / "in", str(tmp_path / "out"), tmp_path / "mark"
    inbox.mkdir()
    go = lambda: incremental.ingest_new(spark, str(inbox), table, "k int, v string", str(mark), ["k"]).awaitTermination()
    (inbox / "a.json").write_text(json.dumps({"k": 1, "v": "a"}) + "\n" + json.dumps({"k": 1, "v": "a"}))
    go()
    (inbox / "b.json").write_text(json.dumps({"k": 1, "v": "again"}) + "\n" + json.dumps({"k": 2, "v": "b"}))
    go()
    go()
    read = lambda: sorted((r.k, r.v) for r in KeyedTable(spark, table, ["k"]).read().collect())
    assert read() == [(1, "again"), (2, "b")]
    # without its commit a batch runs again under its old number
    last = max((f for f in (mark / "commits").iterdir() if f.name.isdigit()), key=lambda f: int(f.name))
    last.unlink()
    (mark / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    go()
    assert read() == [(1, "again"), (2, "b")]


def test_only_changed_files_are_read(spark, tmp_path):
    inbox, asked = tmp_path / "in", []
    inbox.mkdir()
    table = KeyedTable(spark, str(tmp_path / "table"), ["path"], 4)

    def read(changed):
        asked.append(sorted((r.path, r.mtime) for r in changed.collect()))
        return changed.where("path <> 'gone' or mtime < 3").select("path", "mtime", F.explode(F.array(F.lit("x"), F.lit("y"))).alias("block"))

    def go(name, rows):
        (inbox / f"{name}.json").write_text("\n".join(json.dumps({"path": p, "mtime": m}) for p, m in rows))
        stream = spark.readStream.schema("path string, mtime long").json(str(inbox))
        incremental.ingest_changes(stream, read, table, str(tmp_path / "mark")).awaitTermination()

    go("1", [("a", 1), ("b", 1), ("gone", 1), ("a", 1)])
    go("2", [("a", 1), ("b", 2), ("gone", 1), ("c", 2)])
    go("3", [("a", 1), ("b", 1), ("gone", 3), ("c", 2)])
    assert asked == [[("a", 1), ("b", 1), ("gone", 1)], [("b", 2), ("c", 2)], [("gone", 3)]]
    assert sorted((r.path, r.mtime, r.block) for r in table.read().collect()) == [(p, m, b) for p, m in (("a", 1), ("b", 2), ("c", 2)) for b in "xy"]
