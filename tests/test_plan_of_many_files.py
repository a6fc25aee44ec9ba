"""Very many small files: what the driver keeps of them, how they are written, and that none is lost."""

import os
import pickle
import tracemalloc

import duckdb
import pytest

from blockloom import catalog
from blockloom.plans import endtoend
from blockloom.sources import datasource, files
from tests.duck import duck_rows, spark_rows


def test_a_plan_of_many_files_is_small_and_whole():
    given = lambda: ((f"/shared/checkpoints/0f0e/pages-1/{k // 200:03x}/page_id={k}.txt", 100 + k % 7919, 1_700_000_000_000_000 + 1_013 * k) for k in range(200_000))
    tracemalloc.start()
    parts = datasource.packed(given(), datasource.PARTITION_BYTES)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(parts) <= datasource.MAX_PARTITIONS and max(len(p.files) for p in parts) <= 128
    assert sum(len(pickle.dumps(p)) for p in parts) < 40 * 200_000 and most < 80 * 200_000
    assert all(f == g for f, g in zip((f for p in parts for f in p.files), given(), strict=True))


@pytest.mark.parametrize("most", [1, 2, 3, 7])
def test_no_file_is_lost_where_partitions_grow(most):
    given = [(f"f{k:03}", 1 + 977 * k % 50_000_000, k) for k in range(300)]
    parts = datasource.packed(given, 1, most)
    assert 1 <= len(parts) <= most and [f for p in parts for f in p.files] == given


def test_partitions_at_most_and_hidden_folders(spark, tmp_path):
    for k in range(40):
        at = tmp_path / f"{k % 4}" / ("_part" if k % 5 == 4 else "part")
        at.mkdir(parents=True, exist_ok=True)
        (at / f"{k}.txt").write_text(f"text {k}")
    df = datasource.load(spark, str(tmp_path), partitionBytes="1", maxPartitions="6")
    assert df.rdd.getNumPartitions() <= 6
    assert sorted(r.text for r in df.collect()) == sorted(f"text {k}" for k in range(40) if k % 5 != 4)


def test_rows_of_one_path_are_one_file(spark, tmp_path):
    rows = [(f"{k % 3}/{k % 50}.txt", None if k == 7 else f"é{k}") for k in range(100)]
    n = files.written(spark.createDataFrame(rows, "path string, content string").selectExpr("path", "coalesce(content, '') as content").repartition(5), f"file://{tmp_path}/out")
    got = {os.path.relpath(os.path.join(d, f), tmp_path / "out"): open(os.path.join(d, f), encoding="utf-8").read() for d, _, fs in os.walk(tmp_path / "out") for f in fs}
    assert n == len(got) == len({p for p, _ in rows})
    assert {p: sorted(x.split("\n")[:-1]) for p, x in got.items()} == {p: sorted(c or "" for q, c in rows if q == p) for p, _ in rows}


def test_pages_are_written_without_a_folder_each(spark, tmp_path, monkeypatch):
    rows = [(k - 5, f"http://a/{k}", None if k % 100 == 0 else f"<h1>Page {k}</h1><p>said</p>\n<p>é {k}</p>") for k in range(2_500)]
    spark.createDataFrame([*rows, (None, "http://a/", "<p>of no page</p>")], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    seen, load = [], datasource.load
    monkeypatch.setattr(endtoend.datasource, "load", lambda spark, folder, **x: seen.append(folder) or load(spark, folder, **x))
    got = spark_rows(catalog.QUERIES["parser_source"](spark, str(tmp_path)))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == duck_rows(con, catalog.SQL["parser_source"])
    walked = list(os.walk(seen[0].removeprefix("file://").replace("file:", "")))
    assert len(walked) <= 1 + 1_024 and sum(len(fs) for _, _, fs in walked) == 2_501


def test_rows_of_several_files_go_together(tmp_path):
    for k in range(60):
        (tmp_path / f"{k:02}.txt").write_text("\n".join(f"{k}-{i}" for i in range(k)))
    reader = datasource.BlockReader({"path": str(tmp_path)}, files.builtin_readers())
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert len(batches) < 10
    assert [r["text"] for b in batches for r in b.to_pylist()] == [f"{k}-{i}" for k in range(60) for i in range(k)]
