import json

import pytest
from pyspark.sql import functions as F

from blockloom.config import Config
from blockloom.functions import models
from blockloom.functions.prompts import Prompts
from blockloom.operators import pipeline, sinks
from blockloom.plans import stubs
from blockloom.streaming.streams import Breaker
from tests.test_operators import T, docs


def given(spark):
    return docs(spark, [T("Alpha paragraph"), {"type": "image", "img_path": "a.png", "captions": ["c"]}, T("Beta"), {"type": "table", "table_body": "x|y", "page_idx": 1}], [{"type": "image", "img_path": "b.png"}, {"type": "image", "img_path": "b.png"}])


def test_ingest(spark):
    out = pipeline.ingest(given(spark), models.stub_text, stubs.first_words)
    chunks = out.chunks.collect()
    assert sorted((r.doc_id, r.chunk_order_index, r.original_type) for r in chunks) == [(0, 0, None), (0, 1, None), (0, 2, "image"), (0, 3, "table"), (1, 0, "image")]
    assert {r.content for r in chunks if r.original_type is None} == {"Alpha paragraph", "Beta"}
    assert all("about " in r.content for r in chunks if r.original_type)
    names = {r.entity_name for r in out.nodes.collect()}
    assert {"Alpha", "Beta"} <= names and sum("(thing)" in n for n in names) == 3
    edges = out.edges.collect()
    assert edges and all("(thing)" in r.a + r.b for r in edges)
    state = {r.doc_id: r for r in out.doc_status.collect()}
    assert state[0].chunks_count == 4 and len(state[0].chunks_list) == 4 and state[1].multimodal_processed
    assert {r.doc_id: r["count"] for r in out.full_entities.collect()} == {0: 2, 1: 1}
    again = pipeline.ingest(given(spark), models.stub_text, stubs.first_words, done=out.doc_status)
    assert again.chunks.where("original_type is not null").count() == 0
    assert pipeline.ingest(given(spark), models.stub_text, stubs.first_words, skip_multimodal=True).chunks.count() == 2
    assert pipeline.ingest(given(spark), models.stub_text, stubs.first_words, Config(enable_image=False)).chunks.where("original_type = 'image'").count() == 0


def test_failing_models_fail_row_by_row(spark):
    def load():
        def call(prompts):
            if any("b.png" in p for p in prompts):
                raise RuntimeError("no")
            return models.stub_text()(prompts)

        return call

    rows = pipeline.ingest(given(spark), load, stubs.first_words).chunks.where("original_type is not null").collect()
    assert sorted((r.doc_id, r.error) for r in rows) == [(0, None), (0, None), (1, "RuntimeError: no")] or sorted((r.doc_id, r.error or "") for r in rows) == [(0, ""), (0, ""), (1, "RuntimeError: no")]


def test_retrieve_and_answer(spark):
    texts = spark.createDataFrame([(1, "cats purr loudly"), (2, "dogs bark"), (3, "fish swim")], "chunk_id long, content string")
    v = texts.select(F.col("chunk_id").alias("vec_id"), models.embeddings(F.col("content"), models.stub_vectors(32), 32).alias("embedding"))
    q = spark.createDataFrame([(7, "why do cats purr")], "query_id long, question string")
    qv = q.select(F.col("query_id").alias("vec_id"), models.embeddings(F.col("question"), models.stub_vectors(32), 32).alias("embedding"))
    edges = spark.createDataFrame([(1, 1, 2)], "edge_id long, a long, b long")
    of = texts.select(F.col("chunk_id").alias("entity"), "chunk_id")
    got = {m: [r.chunk_id for r in pipeline.retrieve(m, qv, v, v, v, edges, of).orderBy("rank").collect()] for m in ("naive", "local", "global", "hybrid", "mix", "bypass")}
    assert got["naive"][0] == 1 and got["local"][:2] == [1, 2] and set(got["global"]) == {1, 2} and got["bypass"] == [] and got["mix"][0] == 1
    a = pipeline.answered(q, pipeline.retrieve("naive", qv, v, v, v, edges, of), texts, models.stub_text).first()
    assert "about" in a.answer and a.error is None
    with pytest.raises(ValueError):
        pipeline.retrieve("other", qv, v, v, v, edges, of)


def test_cached_questions(spark):
    s = "query_id long, question string, items array<struct<type:string,img_path:string,table_body:string,text:string>>"
    q = spark.createDataFrame([(1, "a", [("table", None, "t", None)]), (2, "b", [])], s)
    first = pipeline.answered_with_items(q, models.stub_text)
    assert not first.where("cached").count()
    again = pipeline.answered_with_items(q, models.stub_text, first.where("query_id = 1"))
    assert {r.query_id: r.cached for r in again.collect()} == {1: True, 2: False}
    assert {r.query_id: r.answer for r in again.collect()} == {r.query_id: r.answer for r in first.collect()}


def test_answers_are_kept_and_not_asked_again(spark, tmp_path):
    s = "query_id long, question string, items array<struct<type:string,img_path:string,table_body:string,text:string>>"
    q = spark.createDataFrame([(1, "a", []), (2, "b", [])], s)
    folder = str(tmp_path / "answers")
    assert sinks.answer_cache(spark, folder) is None
    sinks.save_answers(pipeline.answered_with_items(q.where("query_id = 1"), models.stub_text), folder)
    second = pipeline.answered_with_items(q, models.stub_text, sinks.answer_cache(spark, folder))
    assert {r.query_id: r.cached for r in second.collect()} == {1: True, 2: False}
    assert sinks.save_answers(second, folder) == 1
    assert all(r.cached for r in pipeline.answered_with_items(q, models.stub_text, sinks.answer_cache(spark, folder)).collect())


def test_embeddings_check_their_length(spark):
    df = spark.createDataFrame([("a b",), (None,), ("",)], "t string")
    got = [r.e for r in df.select(models.embeddings(F.col("t"), models.stub_vectors(4), 4).alias("e")).collect()]
    assert got[1] is None and abs(sum(x * x for x in got[0]) - 1) < 1e-6 and sum(got[2]) == 0
    with pytest.raises(Exception):
        df.select(models.embeddings(F.col("t"), models.stub_vectors(4), 5)).collect()


def test_retry_and_breaker():
    waits, calls = [], []

    def flaky(ok_after):
        calls.append(1)
        if len(calls) < ok_after:
            raise OSError("x")
        return "ok"

    assert models.retry(flaky, 4, base=1, most=3, jitter=False, sleep=waits.append)(4) == "ok" and waits == [1, 2, 3]
    calls.clear()
    with pytest.raises(OSError):
        models.retry(flaky, 2, sleep=lambda s: None)(9)
    with pytest.raises(OSError):
        models.retry(flaky, 5, on=(KeyError,), sleep=lambda s: None)(99)
    now = [0.0]

    def bad():
        raise OSError

    call = models.guarded(bad, Breaker(2, 10), lambda: now[0])
    for _ in range(2):
        with pytest.raises(OSError):
            call()
    with pytest.raises(models.Rejected):
        call()
    now[0] = 20
    with pytest.raises(OSError):
        call()


def test_prompts(spark):
    p = Prompts().register("de", {"image": "Bild {image_path}"})
    assert p.available() == ["de", "en", "zh"] and p.use("DE_at").get("image").startswith("Bild") and p.use("de").get("table") == p.get("table")
    assert Prompts().available() == ["en", "zh"]
    with pytest.raises(ValueError):
        p.use("xx")
    assert p.table(spark).count() == 3 * 12
    df = given(spark).select("doc_id", F.inline("blocks")).where("type = 'image'").withColumn("context", F.lit("{x} near"))
    r = df.select(p.for_blocks(F.col("context")).alias("a"), p.for_blocks(F.lit("")).alias("b")).first()
    assert "{x} near" in r.a and "a.png" in r.a and "near" not in r.b and '{"detailed_description"' in r.b


def test_sinks(spark, tmp_path):
    r = spark.createDataFrame([("q" * 120, "r" * 201, 1)], "question string, reasoning string, accuracy int")
    sinks.evaluation_report(r, str(tmp_path / "e"))
    s = spark.read.option("header", True).csv(str(tmp_path / "e/summary")).first()
    assert s.question == "q" * 100 + "..." and s.reasoning == "r" * 200 + "..."
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps(x) for x in ({"question": "a", "answer": "1"}, {"question": " "}, {"question": "b", "correct_answer": "2"})))
    (tmp_path / "c.json").write_text(json.dumps([{"question": "x", "answer": "y"}]))
    assert [tuple(x) for x in sinks.question_bank(spark, str(tmp_path / "b.jsonl")).collect()] == [("a", "1"), ("b", "2")]
    assert sinks.question_bank(spark, str(tmp_path / "c.json"), 1).first().answer == "y"


def test_each_block_is_described_by_one_call(spark, tmp_path):
    """All relations read the same answers, although the model's vary."""
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        def call(prompts):
            for _ in prompts:
                open(os.path.join(folder, uuid.uuid4().hex), "w").close()
            return ['{"detailed_description": "d", "entity_info": {"entity_name": "%s", "entity_type": "t", "summary": "s"}}' % uuid.uuid4().hex for _ in prompts]

        return call

    out = pipeline.ingest(given(spark), load, stubs.first_words)
    names = {r.modal_entity_name for r in out.chunks.where("original_type is not null").collect()}
    assert names <= {r.entity_name for r in out.nodes.collect()} and {x for r in out.full_entities.collect() for x in r.entity_names} == names
    assert {x for r in out.edges.collect() for x in (r.a, r.b) if "(t)" in x} <= names and out.doc_status.count() == 2
    assert len(list(tmp_path.iterdir())) == 4  # the blocks that aren't text


def test_split_options(spark):
    d = spark.createDataFrame([(1, "one two three. four five. six", "x"), (2, "", "x")], "doc_id int, text_content string, tokens string")
    c = Config(chunk_size=2, chunk_overlap=1)
    got = lambda **k: [(r.doc_id, r.chunk_order_index, r.content, r.tokens) for r in pipeline.text_chunks(d, "doc_id", c, **k).orderBy("doc_id", "chunk_order_index").collect()]
    assert got(split=".", split_only=True) == [(1, 0, "one two three", 3), (1, 1, "four five", 2), (1, 2, "six", 1)]
    assert got(split=".") == [(1, 0, "one two", 2), (1, 1, "two three", 2), (1, 2, "four five", 2), (1, 3, "six", 1)]
    assert [x[2] for x in got(by_tokens=True)] == ["one two", "two three.", "three. four", "four five.", "five. six"]


def test_a_modality_of_ones_own(spark):
    m = pipeline.Modality("sensor", lambda context: F.concat(F.lit("read "), F.col("extra"), F.lit(" near "), context), lambda said: F.concat(F.lit("Sensor: "), said))
    d = docs(spark, [T("hall"), {"type": "sensor", "extra": "21 C"}])
    asked = pipeline.described(d.select("doc_id", F.inline("blocks")), lambda: lambda prompts: [json.dumps({"detailed_description": p, "entity_info": {"entity_name": "n", "entity_type": "t", "summary": "s"}}) for p in prompts], own=(m,)).first()
    assert asked.entity.description == "read 21 C near hall" and asked.processor == "sensor_processor"
    r = pipeline.ingest(d, models.stub_text, stubs.first_words, own=(m,)).chunks.where("original_type = 'sensor'").first()
    assert r.content.startswith("Sensor: about ")


def test_folders(spark, tmp_path):
    """Files of all kinds go to their parsers; failures are rows; a second run takes what hasn't changed from the cache."""
    from blockloom.operators.callbacks import Callbacks, document_events
    from blockloom.operators import status
    from blockloom.sources import files

    (tmp_path / "in").mkdir()
    for name, body in (("a.html", "<h1>Alpha Title</h1><table><tr><td>x<td>y</table>"), ("b.md", "# Beta\n\ntext"), ("c.pdf", "%PDF"), ("d.txt", "boom"), ("skip.csv", "1")):
        (tmp_path / "in" / name).write_text(body)

    def fail(raw, path):
        if b"boom" in raw:
            raise ValueError("bad file")
        return [{"text": raw.decode()}]

    registry = files.Registry(files.builtin_parsers())
    registry.register("strict", files.parser_of(fail))
    told = Callbacks(lambda: 0.0)
    listed, none = pipeline.ingest_folder(spark, str(tmp_path / "in"), registry, models.stub_text, stubs.first_words, dry_run=True)
    assert none is None and [(r.path.rsplit("/", 1)[1], r.parser) for r in listed.collect()] == [("a.html", "html"), ("b.md", "text"), ("c.pdf", "pdf"), ("d.txt", "text")] and "content" not in listed.columns
    parsed, out = pipeline.ingest_folder(spark, str(tmp_path / "in"), registry, models.stub_text, stubs.first_words, callbacks=told)
    rows = {r.path.rsplit("/", 1)[1]: r for r in parsed.collect()}
    assert [(b.type, b.text_level, b.text, b.table_body) for b in rows["a.html"].blocks] == [("text", 1, "Alpha Title", None), ("table", 0, None, "x | y")]
    assert [b.text for b in rows["b.md"].blocks] == ["Beta", "text"] and rows["c.pdf"].error == "no parser pdf" and rows["c.pdf"].blocks is None
    assert {r.doc_id.rsplit("/", 1)[1] for r in out.chunks.where("original_type = 'table'").collect()} == {"a.html"}
    assert [e[0] for e in told.events] == ["batch_start", "parse_start", "parse_complete", "multimodal_start", "multimodal_complete", "text_insert_start", "text_insert_complete", "batch_complete"]
    assert told.events[-1][5] == {"files": "4", "failed": "1"}
    found = files.scan_folder(spark, str(tmp_path / "in"))
    by = F.when(F.endswith("path", F.lit(".txt")), " Strict ").otherwise(files.route("path"))
    strict = {r.path.rsplit("/", 1)[1]: r.error for r in files.dispatch(found, registry, by).collect()}
    assert strict["d.txt"] == "ValueError: bad file" and strict["b.md"] is None
    sinks.save_parsed(parsed, str(tmp_path / "cache"))
    (tmp_path / "in" / "b.md").write_text("changed")
    import os

    os.utime(tmp_path / "in" / "b.md", (1, 1))
    again = {r.path.rsplit("/", 1)[1]: r.cached for r in files.dispatch(files.scan_folder(spark, str(tmp_path / "in"), (".html", ".md", ".pdf", ".txt")), registry, cache=sinks.parsed_cache(spark, str(tmp_path / "cache"))).collect()}
    assert again == {"a.html": True, "b.md": False, "c.pdf": False, "d.txt": True}
    assert files.scan_folder(spark, str(tmp_path / "in"), limit=2).count() == 2 and sinks.parsed_cache(spark, str(tmp_path / "nowhere")) is None
    states = status.document_states(parsed.select(F.col("path").alias("doc_id"), "error"), out.chunks)
    events = {(r.doc_id.rsplit("/", 1)[1], r.event_type, r.error) for r in document_events(states, "2024-01-01").collect()}
    assert ("c.pdf", "document_error", "no parser pdf") in events and ("a.html", "document_complete", None) in events


def test_states(spark):
    from blockloom.operators import status

    parsed = spark.createDataFrame([(1, None), (2, "x"), (3, None), (4, None), (5, None)], "doc_id int, error string")
    made = spark.createDataFrame([(1, None), (1, "e"), (3, "f"), (3, "e"), (5, None)], "doc_id int, error string")
    got = {r.doc_id: (r.status, r.error, r.chunks_count) for r in status.document_states(parsed, made, spark.createDataFrame([(5,)], "doc_id int")).collect()}
    assert got == {1: ("processed", "e", 2), 2: ("failed", "x", 0), 3: ("failed", "e", 2), 4: ("ready", None, 0), 5: ("handling", None, 1)}


def test_images_reach_the_vision_model(spark):
    q = spark.createDataFrame([("1", "what?", "see\nImage Path: /w/a.png\nand\nImage Path: /w/b.png\nImage Path: /etc/c.png"), ("2", "why?", "no image"), ("3", None, None)], "query_id string, question string, prompt string")
    files = spark.createDataFrame([("/w/a.png", b"abc")], "path string, content binary")

    def load():
        def call(requests):
            if any("why" in str(r) for r in requests):
                raise OSError("down")
            return [json.dumps(r["images"]) for r in requests]

        return call

    got = {r.query_id: (r.answer, r.error, r.n_images) for r in pipeline.answered_with_images(q, load, ["/w"], files).collect()}
    assert json.loads(got["1"][0]) == ["YWJj", "/w/b.png"] and got["1"][1:] == (None, 2) and got["2"][:2] == (None, "OSError: down")


def test_items_are_described_first(spark):
    s = "query_id long, question string, items array<struct<type:string,img_path:string,table_body:string,text:string>>"
    q = spark.createDataFrame([(1, "a", [("table", None, "T", None), ("image", "/i.png", None, None), ("odd", None, None, "O")]), (2, "b", [])], s)
    describe = lambda: lambda prompts: [f"<{p[-1]}>" for p in prompts]
    echo = lambda: lambda prompts: prompts
    got = {r.query_id: r.answer for r in pipeline.answered_with_items(q, echo, describe=describe).collect()}
    assert "Related table content: <T>" in got[1] and "Related image content: Image path: /i.png" in got[1] and "Related odd content: <O>" in got[1] and "Related" not in got[2]


def test_tokens(spark):
    df = spark.createDataFrame([("a bb  ccc d",), ("",), (None,)], "t string")
    got = df.select(models.token_counts(F.col("t"), models.stub_encoder).alias("n"), models.within_tokens(F.col("t"), 2, models.stub_offsets).alias("s")).collect()
    assert [tuple(r) for r in got] == [(4, "a bb  ..."), (0, ""), (None, None)]


def test_workbooks_and_answers(spark, tmp_path):
    import zipfile

    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Answer</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>5</v></c><c r="C2"><v>42</v></c></row><row r="3"><c r="A3"/></row></sheetData></worksheet>'
    shared = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t> Question </t></si><si><r><t>What </t></r><r><t>is it?</t></r></si></sst>'
    with zipfile.ZipFile(tmp_path / "q.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", shared)
    assert [tuple(r) for r in sinks.question_bank(spark, str(tmp_path / "q.xlsx")).collect()] == [("What is it?", "42")]
    a = spark.createDataFrame([("1", "x", None), ("2", None, "e")], "query_id string, answer string, error string")
    sinks.answer_files(a, str(tmp_path / "out"), 10.0, 13.0)
    r = spark.read.option("header", True).csv(str(tmp_path / "out/timing")).first()
    assert (r.n_questions, r.n_failed, r.seconds, r.seconds_each) == ("2", "1", "3.0", "1.5") and spark.read.json(str(tmp_path / "out/answers")).count() == 2
