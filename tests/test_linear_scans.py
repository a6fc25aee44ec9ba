"""Long, cut short and hostile answers take one scan, and mean what they did."""

import re
import time

import pytest
from pyspark.sql import functions as F

from blockloom.functions import repair as R
from blockloom.functions import text as X

N = 10**6
LONG = {
    "spaces": "a" + " " * N + "b",
    "escapes": '{"summary": "' + '\\"' * N,
    "thoughts": "<think>" * (N // 7),
    "mixed thoughts": "<think><thinking>" * (N // 17) + "</think>",
    "fences": "```json {" * (N // 9),
    "closed fences": "```json {} ``" * (N // 13),
    "braces": "{" * N,
    "ends": "}" * N,
    "quotes": '"' * N,
    "named": '"summary": "x' * (N // 13),
    "commas": "," + " ," * (N // 2),
}


@pytest.mark.parametrize("name", LONG)
def test_hostile_answers_end(spark, name):
    df = spark.createDataFrame([(LONG[name],)], "x string")
    start = time.time()
    row = df.select(X.strip("x").alias("a"), X.strip_thinking("x").alias("b"), X.json_cleanup("x").alias("c"), X.json_fields("x").alias("d"), R.parsed(F.col("x")).alias("e")).first()
    assert time.time() - start < 20
    assert row.a == LONG[name].strip() and row.e is not None


def test_fields_with_escapes_and_cuts(spark):
    rows = [r'{"detailed_description": "say \"hi\" now", "summary": "a\\", "entity_type": "t"', r'{"detailed_description": "cut \"short', '{"summary":\n "line\nend"}', '{"summary": ""}', ""]
    got = [tuple(r.f) for r in spark.createDataFrame([(x,) for x in rows], "x string").select(X.json_fields("x").alias("f")).collect()]
    assert got == [
        (r"say \"hi\" now", "unknown_entity", "t", r"a\\"),
        ("", "unknown_entity", "unknown", ""),
        ("", "unknown_entity", "unknown", "line\nend"),
        ("", "unknown_entity", "unknown", ""),
        ("", "unknown_entity", "unknown", ""),
    ]


def test_thoughts_as_the_plain_pattern_takes_them(spark):
    texts = ["<think>a</think>b", "x<THINK>a\n</Think> y <think>open", "<think>a<think>b</think>c</think>", "<thinking>a</think>b</thinking>c", "</think>a<think>b", "<think>ä</think>İ<THINKING>x</thinking>", "no", ""]
    want = []
    for t in texts:
        for tag in ("think", "thinking"):
            t = re.sub(f"<{tag}>.*?</{tag}>", "", t, flags=re.I | re.S)
        want.append(t.strip())
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, x string")
    assert [r.y for r in df.orderBy("k").select(X.strip_thinking("x").alias("y")).collect()] == want
    plain = [re.sub(r"<(think|thinking)>.*?</\1>", "", t, flags=re.I | re.S) for t in texts]
    assert [R.without_thinking(t) for t in texts] == plain


def test_fences_as_the_plain_pattern_takes_them():
    texts = ['```json\n{"a": 1}\n``` and ```{"b": {}} ```', "```json {x} ```{y}```", "````json{a}````", "```{a}", "{a}```", "```json\n{a} {b}\n``` {c}```"]
    assert [R.fenced(t) for t in texts] == [re.findall(r"```(?:json)?\s*(\{.*?\})\s*```", t, re.S) for t in texts]
