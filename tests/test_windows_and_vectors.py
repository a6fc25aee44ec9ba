"""Windows at an encoder's offsets, cuts to a budget, and vectors that are made once."""

import os
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.config import Config
from blockloom.functions import models
from blockloom.operators import embedding, pipeline


def texts():
    rng = random.Random(2)
    return ["", " ", "one", " lead and trail ", "ünï 😀😀 é́ 中文字 word", *(" ".join(rng.choice(["a", "bb", "\n", " ", "😀", "word,"]) for _ in range(rng.randrange(200))) for _ in range(30))]


@pytest.mark.parametrize("encoder", ["words", "bytes"])
def test_windows_joined_are_the_text(spark, encoder):
    if encoder == "bytes":
        path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    load = models.stub_offsets if encoder == "words" else models.tokenizer_offsets(path)
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts(), None])], "k int, t string")
    for size, overlap in ((1, 0), (7, 3), (10_000, 5)):
        rows = df.select("t", models.token_windows(F.col("t"), size, overlap, load).alias("w")).collect()
        for r in rows:
            if r.t is None:
                assert r.w is None
                continue
            assert "".join(w.content[w.fresh :] for w in r.w) == r.t and all(r.t[w.start :].startswith(w.content) and w.tokens <= size for w in r.w)
            n = len(load()([r.t])[0])
            assert sum(w.tokens for w in r.w) - overlap * (len(r.w) - 1) == n
    with pytest.raises(ValueError):
        models.windows_of([(0, 1)], 1, 3, 3)


def test_a_text_is_encoded_once(spark, tmp_path):
    def load():
        def run(given):
            open(os.path.join(str(tmp_path), uuid.uuid4().hex), "w").close()
            return models.stub_offsets()(given)

        return run

    df = spark.createDataFrame([("word " * 5000,)], "t string")
    assert df.select(models.within_tokens(F.col("t"), 17, load).alias("s")).first().s == "word " * 17 + "..."
    assert len(df.select(models.token_windows(F.col("t"), 100, 10, load).alias("w")).first().w) == 56
    assert len(list(tmp_path.iterdir())) == 2


def test_ingest_by_an_encoder(spark):
    d = spark.createDataFrame([(1, "one two three four. five six"), (2, "x")], "doc_id int, text_content string")
    got = [(r.doc_id, r.chunk_order_index, r.content, r.tokens) for r in pipeline.text_chunks(d, "doc_id", Config(chunk_size=3, chunk_overlap=1), by_tokens=True, encoder=models.stub_offsets).orderBy("doc_id", "chunk_order_index").collect()]
    assert got == [(1, 0, "one two three ", 3), (1, 1, "three four. five ", 3), (1, 2, "five six", 2), (2, 0, "x", 1)]
    got = [(r.chunk_order_index, r.content) for r in pipeline.text_chunks(d.where("doc_id = 1"), "doc_id", Config(chunk_size=3, chunk_overlap=1), split=".", encoder=models.stub_offsets).orderBy("chunk_order_index").collect()]
    assert got == [(0, "one two three "), (1, "three four"), (2, "five six")]


def counting(folder, dim=8):
    def load():
        call = models.stub_vectors(dim)()

        def run(given):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write("\0".join(given))
            return call(given)

        return run

    return load


def asked(folder):
    return sorted(t for p in folder.iterdir() for t in p.read_text().split("\0"))


def test_only_new_contents_are_embedded(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    store = embedding.vector_store(spark, str(tmp_path / "store"))
    rows = [(1, "a b"), (2, "a b"), (3, "c"), (4, None), (5, "")] + [(10 + k, "hot text") for k in range(300)]
    df = spark.createDataFrame(rows, "k int, content string").repartition(4)
    first = embedding.embedded(df, store, counting(str(calls)), 8, "m").collect()
    assert asked(calls) == ["", "a b", "c", "hot text"] and len(first) == len(rows)
    by = {r.k: r for r in first}
    assert by[4].embedding is None and not by[4].added and all(r.added for r in first if r.content is not None)
    want = np.array(models.stub_vectors(8)()(["a b"])[0])
    assert np.allclose(by[1].embedding, want / np.linalg.norm(want)) and by[1].embedding == by[2].embedding and sum(by[5].embedding) == 0
    more = spark.createDataFrame([(1, "a b"), (7, "new one")], "k int, content string")
    again = {r.k: r.added for r in embedding.embedded(more, store, counting(str(calls)), 8, "m").collect()}
    assert again == {1: False, 7: True} and asked(calls) == ["", "a b", "c", "hot text", "new one"]
    embedding.embedded(more, store, counting(str(calls)), 8, "other").collect()
    assert asked(calls).count("a b") == 2  # another model has vectors of its own
    with pytest.raises(Exception, match="not 9"):
        embedding.embedded(more, store, counting(str(calls)), 9, "third").collect()


def test_packs():
    rows = [(str(k), "t", n) for k, n in enumerate((5, 5, 1, 30, 2, 2, 2, 2))]
    assert [[h for h, _ in p] for p in embedding.packs(iter(rows), 10, 3)] == [["0", "1"], ["2"], ["3"], ["4", "5", "6"], ["7"]]


def test_windows_leave_python_before_a_batch_ends(spark, tmp_path):
    """A batch of 300 texts with 2,600 windows each: while it is read, Python's memory grows by less than its windows take."""

    def load():
        import resource

        def run(given):
            with open(f"{tmp_path}/peaks", "a") as f:
                f.write(f"{resource.getrusage(resource.RUSAGE_SELF).ru_maxrss}\n")
            return models.stub_offsets()(given)

        return run

    text = "word " * 13_000
    df = spark.range(300).coalesce(1).select("id", F.when(F.col("id") != 7, F.concat(F.lit(text), F.lit(" "))).alias("t"))
    got = df.select("id", F.explode(F.array(models.token_windows(F.col("t"), 10, 5, load))).alias("w")).select("id", F.size("w").alias("n"))
    assert [(r.id, r.n) for r in got.orderBy("id").collect()] == [(k, None if k == 7 else 2599) for k in range(300)]
    peaks = [int(x) for x in open(f"{tmp_path}/peaks").read().split()]
    assert max(peaks[20:]) - peaks[19] < 100 << 10
