import json

import pytest
from pyspark.sql import functions as F

from blockloom.functions import repair as R
from blockloom.functions import text as X


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("<think>some reasoning here</think>final answer", "final answer"),
        ("<THINK>a\nb</THINK>\n x <thinking>y</thinking>", "x"),
        ("no tags", "no tags"),
        ("<think>only</think>", ""),
        ("", ""),
        ("<think>a</think>1<think>b</think>2", "12"),
    ],
)
def test_strip_thinking(spark, given, want):
    assert one(spark, X.strip_thinking("x"), x=given) == want
    assert R.without_thinking(given).strip() == want


def python_truncate(s, n):
    if len(s) <= n:
        return s
    t = s[:n]
    if t.rfind(".") > len(t) * 0.8:
        return t[: t.rfind(".") + 1]
    if t.rfind("\n") > len(t) * 0.8:
        return t[: t.rfind("\n")]
    return t + "..."


@pytest.mark.parametrize("s", ["", "short", "a" * 50, "a" * 9 + "." + "b" * 20, "a" * 9 + "\n" + "b" * 20, ".aaaaaaaaaaaaaaa", "aaaaaaa.aa", "aaaaaaaa.aa", "aaaaaaaa\n.aaa", "é" * 9 + ".x" * 5])
def test_truncate(spark, s):
    assert one(spark, X.truncate("x", 10), x=s) == python_truncate(s, 10)


def test_json_repair_cascade():
    full = {"detailed_description": "d", "entity_info": {"entity_name": "n", "entity_type": "t", "summary": "s"}}
    text = json.dumps(full)
    assert R.parse(f"```json\n{text}\n```") == full
    assert R.parse(f"before {text} after") == full
    assert R.parse(f"<think>{{no}}</think>{text}") == full
    assert R.parse(text.replace('"s"}}', '"s",}}')) == full
    assert R.parse(r'{"detailed_description": "\alpha + \cdot"}') == {"detailed_description": r"\alpha + \cdot"}
    assert R.parse('{} {"a": 1}') == {"a": 1}
    assert R.parse('broken "detailed_description": "it is", "entity_name": "N"') == {"detailed_description": "it is", "entity_info": {"entity_name": "N", "entity_type": "unknown", "summary": "it is"}}
    assert R.parse("") == {"detailed_description": "", "entity_info": {"entity_name": "unknown_entity", "entity_type": "unknown", "summary": ""}}


def test_entity_of_an_answer():
    ok = '{"detailed_description": "d", "entity_info": {"entity_name": "n", "entity_type": "t", "summary": "s"}}'
    assert R.entity(ok, "image") == {"description": "d", "entity_name": "n (t)", "entity_type": "t", "summary": "s"}
    assert R.entity(ok, "image", "given")["entity_name"] == "given"
    bad = R.entity("<think>x</think> " + "w" * 120, "table")
    assert bad["description"] == "w" * 120 and bad["summary"] == "w" * 100 + "..." and bad["entity_type"] == "table" and bad["entity_name"].startswith("table_")
    assert R.entity("short", "image")["summary"] == "short"


@pytest.mark.parametrize(
    ("said", "accuracy"),
    [
        ('```json\n{"accuracy": 1, "reasoning": "a", "reasoning": "b"}\n```', 1),
        ('{"accuracy": 0, "reasoning": "cut', 0),
        ('{"accuracy": true}', 1),
        ("{'accuracy': '1'", 1),
        ("Accuracy: 1", 1),
        ("accuracy is 1", 1),
        ('{"accuracy": NaN}', 0),
        ('{"accuracy": Infinity}', 0),
        ('{"accuracy": 5}', 0),
        ('{"accuracy": 0.9}', 0),
        ('{"accuracy": 1e3}', 0),
        ("[" * 100_000, 0),
        ("That is right.", 1),
        ("The answer is correct and matches.", 1),
        ("It is incorrect", 0),
        ("The answer is not correct.", 0),
        ("wrong, that is not true", 0),
        ("It doesn't match", 0),
        ("It isn\u2019t wrong.", 1),
        ("No.", 0),
        ("nothing", 0),
        ("", 0),
    ],
)
def test_accuracy_of_a_judge(said, accuracy):
    assert R.scores(said)["accuracy"] == accuracy


def test_all_scores_of_a_judge(spark):
    full = {"accuracy": 1, "relevance": 0.5, "completeness": 1.0, "faithfulness": 0.0, "clarity": 0.25, "consistency": 0.75, "overall_score": 0.9, "reasoning": 'a "quoted" reason'}
    assert R.scores(json.dumps(full)) == full and R.scores("<think>accuracy: 0</think>```json\n" + json.dumps(full, indent=1) + "\n```") == full
    assert R.scores('{"accuracy": 1, "relevance": 7, "clarity": -1, "reasoning": "cut\x07 of') == {**dict.fromkeys(R.SCORES), "accuracy": 1, "reasoning": "cut  of"}
    r = spark.createDataFrame([(json.dumps(full),), (None,)], "a string").select(R.judged(F.col("a")).alias("j")).collect()
    assert r[0].j.asDict() == full and r[1].j.accuracy == 0 and r[1].j.clarity is None


def test_hostile_answers_break_nothing():
    empty = R.parse("")
    assert R.parse("{" * 50_000 + "}" * 50_000) == empty and R.parse('{"a": ' * 50_000) == empty
    assert R.parse('{"a": NaN, "b": Infinity}') == {"a": None, "b": None}
    assert R.parse('{"detailed_description": "C:' + chr(92) + 'dir' + chr(92) + '"}') == {"detailed_description": "C:" + chr(92) + "dir" + chr(92)}


@pytest.mark.parametrize(("url", "want"), [("https://a.b/c", True), ("http://x", True), ("ftp://h/f", True), ("/local/path", False), ("name", False), ("", False)])
def test_is_url(spark, url, want):
    assert one(spark, X.is_url("x"), x=url) is want


def test_inline_markup(spark):
    assert one(spark, X.inline_markup("x"), x="**b** __c__ *i* _j_ `k` ~~s~~ [t](u) <&> a*b*c") == '<strong>b</strong> <strong>c</strong> <em>i</em> <em>j</em> <code>k</code> <del>s</del> <a href="u">t</a> &lt;&amp;&gt; a*b*c'
    assert one(spark, X.inline_markup("x"), x="`**a** [b](c)` ` *x* snake_case_name 2 * 3 * 4 **open") == "<code>**a** [b](c)</code> ` <em>x</em> snake_case_name 2 * 3 * 4 **open"


def test_paragraphs_and_paths(spark):
    assert one(spark, X.paragraphs("x"), x="a\n\n \n\nb ") == ["a", "b"] and one(spark, X.paragraphs("x"), x=" ") == [" "]
    assert one(spark, X.extension("x"), x="/a.b/C.PDF") == ".pdf" and one(spark, X.extension("x"), x="/a.b/c") == ""
    assert one(spark, X.relative_path("x", "/r"), x="/r/s/f") == "s/f" and one(spark, X.relative_path("x", "/r"), x="/q/f") == "f"
