"""Records that models break, the second question, and descriptions in rounds against a plain version."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from blockloom.functions import models
from blockloom.operators import extraction as E
from blockloom.operators import pipeline
from blockloom.operators import reduction as R
from blockloom.plans import stubs
from tests.test_operators import T, docs

BROKEN = [
    ("entity<|>Ada<|>Person<|>wrote notes", [("Ada", "person", "wrote notes")]),
    ('("entity"<|>"Ada"<|>"person"<|>"wrote (many) notes")', [("Ada", "person", "wrote (many) notes")]),
    ("entity<||>Ada<|person|>x##entity<|>Bob<|>person<|>y", [("Ada", "person", "x"), ("Bob", "person", "y")]),
    ("entity<|>Ada", [("Ada", "unknown", "")]),
    ("- entity<|>Ada<|><|>a<|>b", [("Ada", "unknown", "a b")]),
    ("entity<|><|>person<|>none\nentity<|>" + "x" * 300 + "<|>t<|>d\nnothing\n\n<|>", []),
    ("<think>entity<|>No<|>t<|>d</think>ENTITIES<|>Ada<|>t<|>d<|COMPLETE|>entity<|>After<|>t<|>d", [("Ada", "t", "d")]),
    ("entity<|>“Ada”<|>t<|>it's \"said\"", [("Ada", "t", "it's \"said")]),
    (None, []),
    ("", []),
]
RELATIONS = [
    ("relation<|>a<|>b<|>d<|>Big, old;big<|>7.5", [("a", "b", "d", "big,old", 7.5)]),
    ('("relationship"<|>"a"<|>"b"<|>"d"<|>"k"<|>"9")', [("a", "b", "d", "k", 9.0)]),
    ("relation<|>a<|>b", [("a", "b", "", "", 1.0)]),
    ("relation<|>a<|>b<|>d<|>k<|>strong\nrelation<|>a<|>c<|>d<|>k<|>99\nrelation<|>a<|>d<|>d<|>k<|>-1", [("a", "b", "d", "k", 1.0), ("a", "c", "d", "k", 1.0), ("a", "d", "d", "k", 1.0)]),
    ("relation<|>a<|>a<|>d\nrelation<|>a<|>\nrelation<|>a", []),
]


def test_broken_records(spark):
    df = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(BROKEN)], "k int, a string").orderBy("k")
    got = [[tuple(x) for x in r.e] for r in df.select(E.parsed_entities(E.records(F.col("a"))).alias("e")).collect()]
    assert got == [x for _, x in BROKEN]
    df = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(RELATIONS)], "k int, a string").orderBy("k")
    got = [[tuple(x) for x in r.e] for r in df.select(E.parsed_relations(E.records(F.col("a"))).alias("e")).collect()]
    assert got == [x for _, x in RELATIONS]


def counting(folder, model):
    def load():
        import os
        import uuid

        call = model()

        def run(prompts):
            for p in prompts:
                with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                    f.write(p)
            return call(prompts)

        return run

    return load


@pytest.mark.parametrize("gleanings", [0, 1, 2])
def test_each_chunk_is_asked_once_and_again(spark, tmp_path, gleanings):
    chunks = spark.createDataFrame([("c1", "Ada met Bob. Bob left. Cy came"), ("c2", ""), ("c3", None)], "chunk_id string, content string")
    found = E.extracted(E.answers(chunks, counting(str(tmp_path), stubs.record_writer), gleanings))
    names = {r.description: r.entity_name for r in found.entities.where("chunk_id = 'c1'").collect()}
    assert set(names) == ({"Ada met Bob", "Bob left", "Cy came"} if gleanings else {"Ada met Bob", "Bob left"})
    assert {(r.src_id, r.tgt_id, r.keywords, r.weight) for r in found.relations.collect()} == {(stubs.md5("Ada met Bob")[:8], stubs.md5("Bob left")[:8], "follows,next", 0.0), (stubs.md5("Bob left")[:8], stubs.md5("Cy came")[:8], "follows,next", 1.0)}
    found.entities.count()
    assert len(list(tmp_path.iterdir())) == 2 * (1 + gleanings)  # a chunk without content has no question
    ends = {r.entity_name for r in E.with_ends(found).collect()}
    assert stubs.md5("Cy came")[:8] in ends


def test_a_model_that_fails_leaves_the_other_chunks(spark):
    def load():
        def run(prompts):
            if any("bad" in p for p in prompts):
                raise OSError("down")
            return ["entity<|>A<|>t<|>d"] * len(prompts)

        return run

    said = E.answers(spark.createDataFrame([("1", "bad"), ("2", "good")], "chunk_id string, content string"), load)
    assert {(r.chunk_id, r.turn, r.error) for r in said.collect()} == {("1", 0, "OSError: down"), ("2", 0, None), ("2", 1, None)}
    assert [(r.chunk_id, r.entity_name) for r in E.extracted(said).entities.collect()] == [("2", "A")]


def test_ingest_has_typed_relations(spark):
    out = pipeline.ingest(docs(spark, [T("Ada met Bob. Bob left"), {"type": "table", "table_body": "x|y"}]), models.stub_text, E.extractor(stubs.record_writer), summarise=stubs.short_sums)
    a, b = stubs.md5("Ada met Bob")[:8], stubs.md5("Bob left")[:8]
    edges = {(r.a, r.b): r for r in out.edges.collect()}
    assert edges[tuple(sorted((a, b)))].weight == 0.0 and edges[tuple(sorted((a, b)))].n_keywords == 2 and any(r.weight == 10.0 for r in edges.values())
    nodes = {r.entity_name: r for r in out.nodes.collect()}
    assert nodes[a].description == "Ada met Bob" and nodes[a].entity_type == "even" and nodes[b].entity_type == "odd"
    rows = out.relations.collect()
    assert any(r.content == f"follows,next\t{a}\t{b}\n{a} before {b}" for r in rows) and {x for r in rows for x in (r.src_id, r.tgt_id)} <= nodes.keys()


def bucket(value, n):
    return int(hashlib.md5(value.encode()).hexdigest()[:8], 16) % n


def plain(name, values, budget, span, model):
    """(text, calls): packed and summed up until one is left."""
    size = lambda v: max(1, len(v.split()))
    rows, calls = [((0, 0), v) for v in sorted(set(values))], 0
    if len(rows) == 1 or sum(size(v) for _, v in rows) <= budget:
        return "\n".join(v for _, v in rows), 0
    while len(rows) > 1:
        total = sum(size(v) for _, v in rows)
        buckets = max(1, min(-(-total // (budget * span)), len(rows) // R.FEWEST))
        packs = {}
        for b in range(buckets):
            start = 0
            for k, (at, v) in enumerate(sorted(x for x in rows if bucket(x[1], buckets) == b)):
                packs.setdefault((b, min(start // budget, k // 2)), []).append(v)
                start += size(v)
        rows = []
        for at, vs in packs.items():
            calls += len(vs) > 1
            rows.append((at, model([R.ASK.format(name) + "\n".join(vs)])[0] if len(vs) > 1 else vs[0]))
    return rows[0][1], calls


def test_rounds_are_those_of_a_plain_version(spark, tmp_path):
    said = {"hub": [f"value {k} " + "w " * (k % 9) for k in range(3000)], "few": ["b", "a", "a"], "one": ["x y"], "long": ["w " * 500 + str(k) for k in range(7)], "none": [None, ""]}
    rows = [(n, v) for n, vs in said.items() for v in vs]
    df = spark.createDataFrame(rows, "entity_name string, description string").repartition(6)
    got = {r.entity_name: r for r in R.reduced(df, ["entity_name"], counting(str(tmp_path), stubs.short_sums), 50, span=4).collect()}
    assert got.keys() == said.keys() - {"none"}
    for n, r in got.items():
        assert (r.description, r.n_calls) == plain(n, said[n], 50, 4, stubs.short_sums()), n
        assert r.n_values == len(set(said[n])) and r.n_failed == 0
    prompts = [p.read_text() for p in tmp_path.iterdir()]
    assert len(prompts) == sum(r.n_calls for r in got.values())
    assert all(v.strip() in "\n".join(prompts) for v in said["hub"])  # nothing is cut
    assert max(len(re.findall(r"\S+", p)) for p in prompts if " hub " in p) < 50 + 11 + 11


def test_a_hot_name_of_many_descriptions(spark):
    df = spark.range(100_000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("n"), F.col("id") % 500)).alias("entity_name"), F.concat(F.lit("description number "), "id").alias("description"))
    got = R.reduced(df, ["entity_name"], stubs.short_sums, 300, span=8).where("entity_name = 'hot'").first()
    assert got.description.startswith("sum ") and got.n_values == 90_000 and 900 < got.n_calls < 1500


def test_failing_sums_keep_what_was_said(spark):
    def load():
        def run(prompts):
            raise OSError("down")

        return run

    df = spark.createDataFrame([("n", f"words of value {k}") for k in range(9)], "entity_name string, description string")
    r = R.reduced(df, ["entity_name"], load, 8).first()
    assert sorted(r.description.split("\n")) == [f"words of value {k}" for k in range(9)] and r.n_failed == r.n_calls > 0
