"""The data source: partitions by bytes, filters that reach the listing, parsers of one's own, output folders."""

import json
import os
from datetime import UTC, datetime

import pytest
from pyspark.sql import datasource as D

from blockloom.sources import datasource as S


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    for name, body in (("a.md", "# A\n\ntext"), ("b.html", "<h1>B</h1><p>said"), ("c.pdf", "%PDF"), ("sub/d.txt", "d"), ("_hidden.md", "no"), ("e.own", "x|y")):
        (tmp_path / name).write_text(body)
    os.utime(tmp_path / "a.md", (1000, 1000))
    return tmp_path


def test_files_of_all_kinds(spark, folder):
    rows = S.load(spark, str(folder)).collect()
    got = {(os.path.basename(r.path), r.parser, r.pos, r.text_level, r.text, r.error) for r in rows}
    assert got == {("a.md", "text", 0, 1, "A", None), ("a.md", "text", 1, 0, "text", None), ("b.html", "html", 0, 1, "B", None), ("b.html", "html", 1, 0, "said", None), ("c.pdf", "pdf", None, None, None, "LookupError: no parser pdf"), ("d.txt", "text", 0, 0, "d", None), ("e.own", "generic", None, None, None, "LookupError: no parser generic")}
    assert {os.path.basename(r.path) for r in S.load(spark, str(folder), recursive="false").select("path").collect()} == {"a.md", "b.html", "c.pdf", "e.own"}


def test_a_parser_of_ones_own_fails_file_by_file(spark, folder):
    def read(raw, path):
        if not path.endswith(".own"):
            raise ValueError("not mine")
        return [{"text": x, "page_idx": k} for k, x in enumerate(raw.decode().split("|"))]

    rows = S.load(spark, str(folder), {" Own ": read}, parser="own").collect()
    assert [(r.text, r.page_idx) for r in rows if r.error is None] == [("x", 0), ("y", 1)]
    assert {r.error for r in rows if r.error} == {"ValueError: not mine"} and len(rows) == 6
    with pytest.raises(Exception, match="no parser other"):
        S.load(spark, str(folder), parser="other").collect()


def test_filters_reach_the_listing(spark, folder):
    df = S.load(spark, str(folder))
    when = df.where("mtime < '2001-01-01' and path like '%.md'")
    assert {os.path.basename(r.path) for r in when.collect()} == {"a.md"}
    assert {os.path.basename(r.path) for r in df.where("text = 'd'").collect()} == {"d.txt"}
    reader = S.BlockReader({"path": str(folder)}, {})
    left = list(reader.pushFilters([D.StringEndsWith(("path",), ".md"), D.LessThan(("mtime",), datetime(2001, 1, 1, tzinfo=UTC)), D.EqualTo(("text",), "d"), D.IsNotNull(("path",))]))
    assert left == [D.EqualTo(("text",), "d")]
    assert [os.path.basename(f[0]) for p in reader.partitions() for f in p.files] == ["a.md"]


def test_partitions_by_bytes(spark, folder, monkeypatch):
    files = [(f"f{k:02}", 100 + k, 0) for k in range(20)] + [("large", 5000, 0)]
    monkeypatch.setattr(S, "OPEN_BYTES", 10)
    parts = S.packed(files, 1000)
    assert sorted(f for p in parts for f in p.files) == sorted(files) and max(len(p.files) for p in parts) <= 9
    assert all(sum(s for _, s, _ in p.files) <= 1000 or len(p.files) == 1 for p in parts)
    assert S.load(spark, str(folder), partitionBytes="1").rdd.getNumPartitions() == 5


def test_output_folders_by_stem(spark, tmp_path):
    docs, out = tmp_path / "docs", tmp_path / "out"
    docs.mkdir()
    layouts = {"one": "one/auto/one_content_list.json", "two": "two/two_content_list.json", "three": "three_content_list.json"}
    for stem, at in layouts.items():
        (docs / f"{stem}.pdf").write_text("%PDF")
        (out / at).parent.mkdir(parents=True, exist_ok=True)
        (out / at).write_text(json.dumps([{"type": "text", "text": stem, "text_level": 1}, [{"type": "image", "img_path": "images/i.png", "image_caption": ["c"], "page_idx": 3}, 7], {"type": "image", "img_path": "../../../etc/x.png"}, {"type": "table", "table_body": [["a", "b"]]}]))
    (docs / "none.pdf").write_text("%PDF")
    (docs / "bad.pdf").write_text("%PDF")
    (out / "bad_content_list.json").write_text("{}")
    rows = S.load(spark, str(docs), parser="output", output=str(out)).collect()
    for stem, at in layouts.items():
        base = os.path.dirname(str(out / at))
        got = [(r.type, r.text, r.text_level, r.img_path, r.captions, r.table_body, r.page_idx) for r in rows if r.path.endswith(f"/{stem}.pdf")]
        assert got == [("text", stem, 1, None, [], None, 0), ("image", None, 0, f"{base}/images/i.png", ["c"], None, 3), ("image", None, 0, "", [], None, 0), ("table", None, 0, None, [], '[["a", "b"]]', 0)]
    assert {r.error for r in rows if r.error} == {"FileNotFoundError: no content list for it", "ValueError: no list of blocks"}
