import json

import pytest
from pyspark.sql import functions as F

from blockloom.config import Config
from blockloom.operators import blocks, chunks, context, evaluation, graph, metrics, queries, retrieval, status, vectors
from blockloom.schema import BLOCK
from blockloom.sources import blocks as source
from blockloom.sources import files


def docs(spark, *lists):
    fill = lambda i, b: (i, b.get("type"), b.get("page_idx", 0), b.get("text"), b.get("text_level", 0), b.get("img_path"), b.get("captions"), b.get("footnotes"), b.get("table_body"), None, b.get("text_format"), b.get("extra"))
    return spark.createDataFrame([(k, [fill(i, b) for i, b in enumerate(x)]) for k, x in enumerate(lists)], f"doc_id int, blocks array<struct<{BLOCK}>>")


T = lambda s, **k: {"type": "text", "text": s, **k}


@pytest.mark.parametrize(
    ("given", "text", "items"),
    [
        ([], "", 0),
        ([T("Hello world"), T("Second paragraph")], "Hello world\n\nSecond paragraph", 0),
        ([{"type": "image", "img_path": "a"}, {"type": "table", "table_body": "col1|col2"}], "", 2),
        ([T("a"), {"type": "image"}, T("b"), {"type": "table"}, {"type": "equation", "text": "E=mc^2"}], "a\n\nb", 3),
        ([T("   "), T("Valid text"), T("\n\t")], "Valid text", 0),
        ([{"text": "no type field"}], "no type field", 0),
    ],
)
def test_separate(spark, given, text, items):
    r = blocks.separate(docs(spark, given)).first()
    assert r.text_content == text and len(r["items"]) == items


def test_content_id(spark):
    import hashlib

    r = docs(spark, [T(" a "), {"type": "image", "img_path": "p"}, {"type": "table", "table_body": "b"}, {"type": "equation", "text": "e"}, T("  "), T("")]).select(blocks.content_id("blocks").alias("i")).first()
    assert r.i == "doc-" + hashlib.md5(b'a\nimage:p\ntable:b\nequation:e\n\n{"type":"text","page_idx":0,"text":"","text_level":0}').hexdigest()


def test_content_ids_tell_blocks_without_content_of_their_own_apart(spark):
    """All that a block holds counts, for types of one's own and for images without a path; its place among equal blocks doesn't."""
    given = [[{"type": "image", "captions": ["a"]}], [{"type": "image", "captions": ["b"]}], [{"type": "sensor", "text": "1"}], [{"type": "sensor", "text": "2"}], [{"type": "sensor", "extra": "1"}], [{"type": "audio", "text": "1"}]]
    ids = [r.i for r in docs(spark, *given, *given).select(blocks.content_id("blocks").alias("i")).collect()]
    assert len(set(ids)) == len(given) and ids[: len(given)] == ids[len(given) :]


def plain_context(bs, at, w, page):
    out = []
    for i, b in enumerate(bs):
        near = abs(b.get("page_idx", 0) - bs[at].get("page_idx", 0)) <= w if page else i != at and abs(i - at) <= w
        if near and b["type"] == "text" and b["text"].strip():
            said = "#" * b.get("text_level", 0) + " " * bool(b.get("text_level")) + b["text"]
            out.append(f"[Page {b.get('page_idx', 0)}] {said}" if page and b.get("page_idx", 0) != bs[at].get("page_idx", 0) else said)
    return "\n".join(out)


def test_context_windows(spark):
    bs = [T("H", text_level=2), T("one"), {"type": "image", "page_idx": 1}, T("two", page_idx=1), T(" ", page_idx=1), {"type": "table", "page_idx": 2}, T("three", page_idx=3), T("far", page_idx=9)]
    df = source.exploded(docs(spark, bs, [T("other"), {"type": "image"}]))
    for w in (0, 1, 2):
        for page, f in ((True, context.page_context), (False, context.chunk_context)):
            got = {(r.doc_id, r.pos): r.context for r in f(df, Config(context_window=w)).collect()}
            assert got[0, 2] == plain_context(bs, 2, w, page) and got[0, 5] == plain_context(bs, 5, w, page)
            assert got[1, 1] == ("other" if page or w else "")


def test_contexts_within_rows_and_by_windows_agree(spark, monkeypatch):
    bs = [T(f"t{k}", page_idx=(k * 7) % 5, text_level=k % 2) if k % 3 else {"type": "table", "page_idx": k % 4, "captions": ["c"] * (k % 2)} for k in range(30)]
    df = docs(spark, bs, [T("x")], [], bs[:9])
    for mode, f in (("page", context.page_context), ("chunk", context.chunk_context)):
        for w in (0, 1, 3):
            c = Config(context_mode=mode, context_window=w, context_filter_types=("text", "table"))
            want = sorted((r.doc_id, r.pos, r.context) for r in f(source.exploded(df), c).collect())
            for most in (5000, 20):
                monkeypatch.setattr(context, "LONG", most)
                assert sorted((r.doc_id, r.pos, r.context) for r in context.document_context(df, c).collect()) == want


def test_context_of_captions(spark):
    bs = [{"type": "image", "captions": ["a", "b"]}, {"type": "table", "captions": []}, T("t")]
    got = [r.s for r in source.exploded(docs(spark, bs)).select(context.item_text().alias("s")).collect()]
    assert got == ["[Image: a, b]", "", "t"]


def test_templates(spark):
    bs = [{"type": "image", "img_path": "{captions}", "captions": [], "footnotes": ["f"]}, {"type": "custom_type", "extra": "x"}]
    df = source.exploded(docs(spark, bs)).withColumn("d", F.lit("said"))
    a, b = [r.c for r in df.select(chunks.modal_chunk(F.col("d")).alias("c")).collect()]
    assert a == "\nImage Content Analysis:\nImage Path: {captions}\nCaptions: None\nFootnotes: f\n\nVisual Analysis: said"
    assert b == "Custom_Type Content Analysis:\nContent: x\n\nAnalysis: said"


def test_window_chunks(spark):
    df = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n))) for n in (0, 1, 9, 10, 11, 18, 19, 40)], "k int, text string")
    got = {}
    for r in chunks.window_chunks(df, "k", "text", 10, 2).orderBy("chunk_order_index").collect():
        got.setdefault(r.k, []).append(r.content.split())
    assert 0 not in got
    for n, parts in got.items():
        assert parts[0][0] == "w0" and parts[-1][-1] == f"w{n - 1}" and all(len(p) == 10 for p in parts[:-1])
        assert all(a[-2:] == b[:2] for a, b in zip(parts, parts[1:], strict=False)) and len(parts) == max(1, -(-(n - 2) // 8))
    with pytest.raises(ValueError):
        chunks.window_chunks(df, "k", "text", 5, 5)


def test_full_entities(spark):
    old = spark.createDataFrame([(1, ["Alice"], 1, 100, "x"), (2, ["A", "B", "A2"], 3, 100, "y")], "doc_id int, entity_names array<string>, count int, update_time int, extra string")
    new = spark.createDataFrame([(1, ["Figure 1 (image)"], 222), (2, ["B"], 222), (3, ["N", "M"], 111)], "doc_id int, entity_names array<string>, update_time int")
    got = {r.doc_id: (r.entity_names, r["count"], r.update_time, r.extra) for r in graph.merge_full_entities(old, new).collect()}
    assert got == {1: (["Alice", "Figure 1 (image)"], 2, 222, "x"), 2: (["A", "B", "A2"], 3, 222, "y"), 3: (["N", "M"], 2, 111, None)}


def test_routing(spark):
    df = spark.createDataFrame([("image",), ("table",), ("sound",)], "type string")
    got = {r.type: r.processor for r in graph.route(df, graph.processors(spark, Config(enable_table=False).enabled_types())).collect()}
    assert got == {"image": "image_processor", "sound": "generic_processor"}


def test_batch_summary(spark):
    df = spark.createDataFrame([(True,), (True,), (False,)], "ok boolean")
    r = status.batch_summary(df).first()
    assert (r.n_files, r.n_ok, r.n_failed) == (3, 2, 1) and abs(r.success_rate - 66.666667) < 1e-6
    assert status.batch_summary(df.limit(0)).first().success_rate == 0.0


def test_status_and_upserts(spark):
    wanted = spark.createDataFrame([(1,), (2,), (3,)], "doc_id int")
    have = spark.createDataFrame([(1, "processed", True, 4), (2, "failed", False, 0)], "doc_id int, status string, multimodal_processed boolean, chunks_count int")
    got = {r.doc_id: tuple(r)[1:] for r in status.projection(wanted, have).collect()}
    assert got == {1: (True, True, True, True, 4), 2: (True, False, False, False, 0), 3: (False, False, False, False, 0)}
    assert {r.doc_id for r in status.gate(wanted, have).collect()} == {2, 3}
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x", 0), (2, "y", 1), (3, "z", 2)], "k int, v string, _pos int")
    assert sorted(map(tuple, status.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "y"), (3, "z")]


def test_metrics(spark):
    rows = [("purchase", 1.0), ("purchase", 1.0), ("error", 0.0), ("view", 2.5), ("view", 0.5), ("click", 3.0)]
    r = metrics.accumulate(spark.createDataFrame(rows, "event_type string, value double")).first()
    assert r.asDict() == {"documents_processed": 2, "documents_failed": 1, "total_parse_time": 3.0, "total_insert_time": 0.0, "queries_executed": 1, "total_query_time": 3.0}


def test_evaluation(spark):
    s = "doc_id string, question string, method string, source_file string, accuracy int, success boolean"
    r = spark.createDataFrame([("1/a", "q", "mix", "f", 1, True), ("1/a", "q2", "mix", "f", None, True), ("2/a", "q", "vlm", "f", 0, False)], s)
    assert {x.question for x in evaluation.pending(r.select(*evaluation.KEYS), r).collect()} == {"q2", "q"} and evaluation.existing(r, r).count() == 1
    got = {x.method: (x.n_evaluated, x.n_correct, x.accuracy) for x in evaluation.by(r, "method").collect()}
    assert got == {"mix": (1, 1, 100.0), "vlm": (1, 0, 0.0)}
    ids = spark.createDataFrame([("10/x",), ("9/x",), ("x",), ("a/9",)], "d string").orderBy(evaluation.folder_number("d"), "d").collect()
    assert [x.d for x in ids] == ["9/x", "10/x", "a/9", "x"]


def test_error_summary(spark):
    res = "struct<success:boolean,error:string>"
    s = f"error string, vlm_result {res}, hybrid_result {res}, mix_result {res}, naive_result {res}"
    rows = [(None, None, None, None, None), ("Document not found: x", (False, "context_length_exceeded"), None, (False, None), (True, None)), ("boom", (None, None), (True, "e" * 60), None, None)]
    got = spark.createDataFrame(rows, s).select(evaluation.has_error().alias("e"), evaluation.error_summary().alias("s")).collect()
    assert [tuple(x) for x in got] == [(False, "Unknown error"), (True, "Document not found; VLM token limit exceeded; Mix error: Mix query failed..."), (True, f"Top-level error: boom...; Hybrid error: {'e' * 50}...")]


def test_top_k_matches_brute_force(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[5] = v[6]
    df = spark.createDataFrame([(k, [float(x) for x in r], k % 3) for k, r in enumerate(v)] + [(900, None, 0), (901, [0.0] * 8, 0), (902, [1.0], 0)], "vec_id long, embedding array<float>, label int").repartition(4)
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    s = np.round(u @ u.T, 6)
    for size in (1 << 20, 0):
        monkeypatch.setattr(vectors, "QUERY_BYTES", size)
        got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in retrieval.top_k(df.where("vec_id % 10 = 0"), df, 4, same="label").collect()}
        for q in range(0, 300, 10):
            order = sorted((x for x in range(300) if x != q and x % 3 == q % 3), key=lambda x: (-s[q, x], x))[:4]
            assert [got[q, k + 1][0] for k in range(4)] == order


def test_content_lists(spark, tmp_path):
    five = [T("a"), {"type": "image", "img_caption": ["c"], "page_idx": 1}, [{"type": "table", "table_body": {"r": 1}, "table_caption": "one"}], "noise", {"text": "untyped"}]
    (tmp_path / "a.json").write_text(json.dumps(five))
    (tmp_path / "b.json").write_text('{"not": "a list"}')
    (tmp_path / "c.json").write_text("broken")
    got = {r.doc_key.rsplit("/", 1)[1]: r.blocks for r in source.content_list(spark, str(tmp_path)).collect()}
    assert got["b.json"] is None and got["c.json"] is None
    assert [(b.type, b.text, b.captions, b.table_body, b.page_idx) for b in got["a.json"]] == [("text", "a", None, None, 0), ("image", None, ["c"], None, 1), ("table", None, ["one"], '{"r": 1}', 0), ("text", "untyped", None, None, 0)]


def test_span_trees(spark):
    tree = [{"type": "title", "content": {"title_content": [{"type": "text", "content": " T "}, "x"]}}, {"type": "list", "content": {"list_items": [{"prefix": "1.", "item_content": {"content": ["a", {"text": "b"}]}}, {"item_content": ""}]}}, {"type": "table", "content": {"html": " <t/> "}}, {"type": "image", "content": {"image_caption": ["c", ""]}}, {"type": "text", "text": " z "}, {"type": "other", "content": {}}]
    df = spark.createDataFrame([(json.dumps(tree),), ("x",), (None,)], "raw string").select(source.span_text(F.col("raw")).alias("p"))
    assert [r.p for r in df.collect()] == ["T x\n\n1. a b\n\n<t/>\n\nc\n\nz", None, None]


def test_recognised_lines(spark):
    rows = [[[[[0, 0], ["First line", 0.99]], [[1, 1], ["Second line", 0.95]]]], [{"rec_texts": ["Same", "Same", " "]}], []]
    df = spark.createDataFrame([(json.dumps(x),) for x in rows] + [(None,)], "raw string").select(source.recognised_lines(F.col("raw")).alias("l"))
    assert [r.l for r in df.collect()] == [["First line", "Second line"], ["Same", "Same"], [], []]


def test_reference_tree_survives_cycles_and_dead_ends(spark):
    s = "doc_key string, type string, idx int, children array<string>, label string, text string, image string"
    rows = [("d", "body", 0, ["#/groups/0", "#/texts/9", "#/texts/1"], "", None, None), ("d", "groups", 0, ["#/texts/0", "#/pictures/0"], "", None, None), ("d", "texts", 0, ["#/groups/0"], "formula", "x=1", None), ("d", "texts", 1, [], "paragraph", "end", None), ("d", "pictures", 0, [], "", None, "cG5n"), ("e", "body", 0, [], "", None, None)]
    got = sorted((r.pos, r.type, r.text, bytes(r.image) if r.image else None) for r in source.reference_tree(spark.createDataFrame(rows, s)).collect())
    assert got == [(0, "equation", "x=1", None), (1, "image", None, b"png"), (2, "text", "end", None)]


def html_of(spark, page):
    return [tuple(r)[2:] for r in source.html(spark.createDataFrame([(1, page), (2, None)], "id int, html string"), "id", "html").orderBy("pos").collect()]


def test_html(spark):
    page = "<head><title>no</title></head><nav><li>menu</nav><h2>Head &amp; all</h2><p>one<br>two <b>bold</b><div>div</div><ul><li>x<li>y</ul><script>var a='<p>'</script><table><caption>Cap</caption><tr><th>a<th>b<tr><td>1</td><td><p>2</p> c</table>tail<img src='i.png' alt=' pic '>"
    text = lambda t, level=0: ("text", level, t, None, [], None)
    assert html_of(spark, page) == [text("Head & all", 2), text("one two bold"), text("div"), text("x"), text("y"), ("table", 0, None, None, ["Cap"], "a | b\n1 | 2 c"), text("tail"), ("image", 0, None, "i.png", ["pic"], None)]


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<html><head><title>t</title><body><p>hello", ["hello"]),
        ("<html><head><title>t</title><p>hello", ["t", "hello"]),
        ("<nav><p>menu<h1>Title</h1><p>rest", ["menu", "Title", "rest"]),
        ("<p>a</p><footer>f<p>b", ["a", "f", "b"]),
        ("<div><nav><a>menu</a></div><p>after</p>", ["after"]),
        ("<p>a<script>never closed <p>b", ["a"]),
        ("", []),
    ],
)
def test_unclosed_elements_hide_nothing(spark, page, texts):
    assert [r[2] for r in html_of(spark, page)] == texts


def test_a_page_of_very_many_blocks(spark):
    """One page of 50,000 blocks: each row holds the limit's worth of text only."""
    n = 50_000
    df = spark.range(n).select(F.lit("d").alias("doc_id"), F.col("id").cast("int").alias("pos"), F.when(F.col("id") % 100 == 99, "table").otherwise("text").alias("type"), F.lit(0).alias("page_idx"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit(0).alias("text_level"), F.lit(None).cast("array<string>").alias("captions"))
    got = context.page_context(df).select("context").distinct().collect()
    whole = "\n".join(f"text {k}" for k in range(400) if k % 100 != 99)[:2000]
    assert len(got) == 1 and got[0].context in (whole + "...", whole[: whole.rfind("\n")]) and context.page_context(df).count() == n // 100


def test_merges_keep_all_that_was_said(spark):
    rows = [("hub", "t", f"d{k:04}", f"s{k:04}") for k in range(500)] + [("hub", "u", "d0001", "s0001"), ("one", "t", None, "s")]
    n = spark.createDataFrame(rows, "entity_name string, entity_type string, description string, source_id string").repartition(5)
    got = {r.entity_name: r for r in graph.merge_nodes(n).collect()}
    assert tuple(got["hub"])[1:] == ("t", 501, 500, 500) and tuple(got["one"])[1:] == ("t", 1, 1, 0)
    values = graph.node_values(n)
    assert sorted(r.value for r in values.where("entity_name = 'hub' and field = 'description'").collect()) == [f"d{k:04}" for k in range(500)]
    assert values.where("field = 'source_id'").count() == 501
    e = n.selectExpr("'x' as src_id", "entity_name as tgt_id", "1.0 as weight", "description as keywords", "source_id")
    turned = e.selectExpr("src_id as tgt_id", "tgt_id as src_id", "weight", "keywords", "source_id")
    assert {(r.a, r.n_edges, r.n_sources, r.n_keywords) for r in graph.merge_edges(turned).collect()} == {("hub", 501, 500, 500), ("one", 1, 1, 0)}
    assert graph.edge_values(turned).where("field = 'keyword'").count() == 500


def test_search_among_vectors_of_several_lengths(spark):
    rows = [("a", []), ("b", [1.0, 0.0]), ("c", [1.0, 0.1]), ("d", [1.0, 0.0, 0.0]), ("e", [1.0, 0.2, 0.0]), ("f", None), ("g", [0.0, 0.0]), ("h", [None, 1.0]), ("i", [float("nan"), 1.0])]
    v = spark.createDataFrame(rows, "vec_id string, embedding array<float>").repartition(3)
    got = {(r.query_id, r.vec_id) for r in retrieval.top_k(v, v, 2).collect()}
    assert got == {("b", "c"), ("c", "b"), ("d", "e"), ("e", "d")}


def test_query_blocks_give_the_same(spark, monkeypatch):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    want = sorted(map(tuple, retrieval.top_k(v, v, 3, same="label").collect()))
    for name, value in (("QUERY_BYTES", 7000), ("TILE_BYTES", 9000), ("QUERY_ROWS", 3), ("SCAN_ROWS", 11)):
        monkeypatch.setattr(vectors, name, value)
    assert sorted(map(tuple, retrieval.top_k(v, v, 3, same="label").collect())) == want


def test_folder_scan_and_decoding(spark, tmp_path):
    for name in ("doc.pdf", "img.PNG", "data.csv", "readme.py", "sub/more.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    names = lambda df: [r.path.rsplit("/", 1)[1] for r in df.collect()]
    assert names(files.listing(spark, str(tmp_path))) == sorted(names(files.scan_folder(spark, str(tmp_path)))) == ["doc.pdf", "img.PNG", "more.md"]
    assert "content" not in files.listing(spark, str(tmp_path)).columns and "content" in files.scan_folder(spark, str(tmp_path), limit=2).columns
    assert names(files.scan_folder(spark, str(tmp_path), ("PDF", ".csv"), recursive=False, limit=1)) == ["data.csv"]
    assert source.decoded("é".encode("gbk")) == "é" and source.decoded("é".encode()) == "é"


def test_registry():
    r = files.Registry({"mineru": lambda df: df})
    r.register(" Own ", lambda df: df)
    assert r.names() == ["mineru", "own"] and r.get("OWN")
    for bad in (lambda: r.register("mineru", lambda df: df), lambda: r.unregister("mineru"), lambda: r.get("none"), lambda: r.register(" ", lambda df: df)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        r.register("x", 1)
    r.unregister("own")
    assert r.names() == ["mineru"]


def test_cache_key_is_portable(spark):
    s = "q string, items array<struct<type:string,img_path:string,table_body:string,text:string>>"
    long = "x" * 201
    df = spark.createDataFrame([(" q ", [("table", "/a/t.png", long, None)]), ("q", [("table", "/b/t.png", long, None)]), ("q", [("table", "/b/t.png", long + "y", None)])], s)
    a, b, c = [r[0] for r in df.select(queries.cache_key(F.col("q"), F.col("items"), F.lit("mix"))).collect()]
    assert a == b != c and a.startswith("multimodal_query:")


def test_vision_message(spark):
    prompt = "a\nImage Path: /w/x.png\nb\nImage Path: /w/../etc/y.png\nImage Path: /w/d/z.JPG\nImage Path: /w/d/z.jpg\nc"
    df = spark.createDataFrame([(prompt, "q?"), ("no image", "q?")], "p string, q string")
    a, b = queries.vision_messages(df, "p", "q", ["/w"], F.lit("Be brief.")).collect()
    assert a.images == ["/w/x.png", "/w/d/z.jpg"] and a.system.endswith("answers. Be brief.")
    assert [(p.type, p.image) for p in a.parts] == [("text", None), ("image", 0), ("text", None), ("image", 1), ("text", None), ("text", None)]
    assert "/w/../etc/y.png" in a.parts[2].text and a.parts[-1].text.startswith("\n\nUser Question: q?")
    assert [p.text for p in b.parts] == ["Context:\nno image\n\nUser Question: q?"]


def test_image_data(spark):
    from blockloom.functions.text import image_data

    df = spark.createDataFrame([(b"png",), (None,)], "c binary")
    assert [r.d for r in df.select(image_data("c").alias("d")).collect()] == ["cG5n", ""]


def test_config(spark):
    c = Config()
    assert (c.parser, c.parse_method, c.context_window, c.context_mode, c.max_context_tokens, c.use_full_path, c.max_concurrent_files) == ("mineru", "auto", 1, "page", 2000, False, 1)
    spark.conf.set("spark.blockloom.enable_image", "false")
    spark.conf.set("spark.blockloom.context_filter_types", "text, table")
    try:
        own = Config.of(spark)
        assert own.enable_image is False and own.context_filter_types == ("text", "table") and "image" not in own.enabled_types()
    finally:
        spark.conf.unset("spark.blockloom.enable_image")
        spark.conf.unset("spark.blockloom.context_filter_types")


def test_parse_keys_hold_the_options_that_count(spark):
    s = "o map<string,string>"
    rows = [({"lang": "en", "table": "1"},), ({"table": "1", "lang": "en", "other": "x"},), ({"lang": "de"},), ({"other": "x"},), (None,)]
    key = lambda *o: queries.parse_key(F.lit("p"), F.lit(1), F.lit("m"), F.lit("auto"), *o)
    a, b, c, d, e = [r.k for r in spark.createDataFrame(rows, s).select(key(F.col("o")).alias("k")).collect()]
    assert a == b != c and d == e == spark.range(1).select(key().alias("k")).first().k != a


def test_reranking_by_a_model(spark):
    found = spark.createDataFrame([(1, k, 1.0 - k / 10, k + 1) for k in range(5)], "query_id int, chunk_id int, score double, rank int")
    texts = spark.createDataFrame([(0, "no"), (1, "cats purr"), (2, "bad"), (3, "cats")], "chunk_id int, content string")

    def load():
        def run(pairs):
            if any(t == "bad" for _, t in pairs):
                raise OSError("down")
            return [float(sum(w in t for w in q.split())) for q, t in pairs]

        return run

    q = spark.createDataFrame([(1, "cats purr")], "query_id int, question string")
    got = [(r.chunk_id, r.score, r["rank"]) for r in retrieval.reranked(found, q, texts, load, 4).orderBy("rank").collect()]
    assert got == [(1, 2.0, 1), (3, 1.0, 2), (0, 0.0, 3), (2, None, 4)]
    assert [r.chunk_id for r in retrieval.reranked(found, q, texts, load, 4, of=2).orderBy("rank").collect()] == [1, 0]
