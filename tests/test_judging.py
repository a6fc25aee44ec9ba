import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from blockloom.functions.text import markdown_page
from blockloom.operators import context, judging
from blockloom.operators.callbacks import Callbacks

R = "struct<success:boolean,result:string,error:string>"
SCHEMA = f"doc_id string, question string, expected_answer string, vlm_result {R}, hybrid_result {R}, mix_result {R}, naive_result {R}"


def judge():
    def call(prompts):
        if any("boom" in p for p in prompts):
            raise TimeoutError("slow")
        return ['```json\n{"accuracy": %d, "relevance": 0.5}\n```' % ("Answer: right" in p) for p in prompts]

    return call


def test_evaluate_and_replace(spark):
    ok = lambda t: (True, t, None)
    rows = [("d", " q ", "right", None, ok("right"), ok("wrong"), (False, None, "lost")), ("d", " ", "x", ok("x"), None, None, None), ("e", "q", "right", ok("boom"), None, None, None)]
    asked = judging.questions(spark.createDataFrame(rows, SCHEMA))
    got = {(r.doc_id, r.question, r.method): (r.accuracy, r.relevance, r.success, r.error) for r in judging.evaluate(asked, judge).collect()}
    assert got == {("d", "q", "hybrid"): (1, 0.5, True, None), ("d", "q", "mix"): (0, 0.5, True, None), ("d", "q", "naive"): (None, None, False, "lost"), ("e", "q", "vlm"): (None, None, False, "TimeoutError: slow")}
    done = judging.evaluate(asked, judge)
    again = judging.evaluate(asked, judge, done)
    assert {(r.doc_id, r.method) for r in again.collect()} == {("d", "naive"), ("e", "vlm")}
    assert judging.updated(done, again).count() == 4 and judging.evaluate(asked, judge, limit=1).count() == 1
    p = spark.range(1).select(judging.prompt(F.lit("Q"), F.lit("E"), F.lit("A"), "accuracy").alias("p")).first().p
    assert "Question: Q" in p and '"accuracy": 0 or 1' in p and "relevance" not in p


def test_callbacks(spark):
    c, seen = Callbacks(lambda: 0.0), []

    class Bad:
        def on_parse_complete(self, **k):
            raise ValueError

    class Good:
        def on_parse_complete(self, file_path, **k):
            seen.append(file_path)

    bad, good = Bad(), Good()
    for x in (bad, good, good):
        c.register(x)
    c.dispatch("parse_complete", file_path="f", duration_seconds=2, content_blocks=3)
    c.dispatch("document_error", file_path="g", error=OSError("x"), stage="parse")
    c.unregister(good)
    c.dispatch("parse_complete", file_path="h")
    assert seen == ["f"]
    rows = c.table(spark).collect()
    assert [(r.event_type, r.file_path, r.details, r.duration_seconds, r.error) for r in rows] == [("parse_complete", "f", {"content_blocks": "3"}, 2.0, None), ("document_error", "g", {}, None, "x"), ("parse_complete", "h", {}, None, None)]
    with pytest.raises(ValueError):
        c.dispatch("unknown")


def test_markdown_page_and_any_context(spark):
    r = spark.range(1).select(markdown_page(F.lit("# A **b**\n\ntext\n- item\n####### deep")).alias("p"), context.any_context("text", F.lit("t" * 3000), F.lit(0)).alias("c"), context.any_context("texts", F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1)).alias("t")).first()
    assert "<h1>A <strong>b</strong></h1><p>text</p><li>item</li><h6>deep</h6></body></html>" in r.p and len(r.c) == 2003 and r.t == "a\nc"
    with pytest.raises(ValueError):
        context.any_context("x", F.lit(""), F.lit(0))


def test_command_line(tmp_path):
    run = lambda *a: subprocess.run([sys.executable, "-m", "blockloom", *a], capture_output=True, text=True, timeout=120)
    assert "page_context" in run().stdout.split() and run("nothing").returncode == 2
    assert run("supported_files", "/root/testdata/sf0.001", str(tmp_path / "out")).returncode == 0 and (tmp_path / "out/_SUCCESS").exists()


def test_a_folder_from_end_to_end(tmp_path):
    """Ingest, answers and evaluation by the command line, with models for tests."""
    run = lambda *a: subprocess.run([sys.executable, "-m", "blockloom", *map(str, a)], capture_output=True, text=True, timeout=300)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("# Cats\n\ncats purr loudly. They sleep\n\ndogs bark")
    (tmp_path / "bank.jsonl").write_text("\n".join(json.dumps({"question": q, "answer": "x"}) for q in ("why do cats purr", "why do cats purr", " ", "what do dogs do")))
    (tmp_path / "results").mkdir()
    (tmp_path / "results/d.json").write_text(json.dumps([{"question": "q", "expected_answer": "e", "naive_result": {"success": True, "result": "a"}}]))
    got = run("ingest", tmp_path / "in", tmp_path / "out", "blockloom.plans.stubs:record_or_entity")
    assert got.returncode == 0, got.stderr[-2000:]
    import duckdb

    rows = lambda x: duckdb.sql(f"select * from '{tmp_path}/out/{x}/*.parquet'").fetchall()
    assert len(rows("chunks")) == 3 and rows("nodes") and rows("edges") and len(rows("files")) == 1
    got = run("answer", tmp_path / "bank.jsonl", tmp_path / "answers", "blockloom.functions.models:stub_text", tmp_path / "out/chunks", "blockloom.plans.stubs:vectors_of_16", 16)
    assert got.returncode == 0, got.stderr[-2000:]
    answers = duckdb.sql(f"select * from read_json('{tmp_path}/answers/answers/*.json')").fetchall()
    assert len(answers) == 2
    assert run("evaluate", tmp_path / "results", tmp_path / "judged", "blockloom.plans.stubs:fair_judge").returncode == 0
    assert duckdb.sql(f"select accuracy from read_json('{tmp_path}/judged/results/*.json')").fetchall() == [(1,)]
    assert run("evaluate", tmp_path).returncode == 2
