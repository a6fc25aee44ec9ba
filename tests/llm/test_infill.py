"""Units against plain patterns, transformation against plain Python, and the exact way back."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from blockloom.llm import infill

TEXTS = [
    None, "", " ", "\n", "\n\n", "a", "one\n", "one\ntwo", "\none\n\ntwo\n", "no line end", "a b  c\td\r\ne ", "x_1 + y2;\nif(z)", "ünï 😀😀 é́\n😀", "  lead", "has <P> in it\nb", "<S>", "x<M>",
    "<", "<P\n>", "ends in <\n<S\n", "a b\x85c\n", "\x00\x01\n", "\r\n\r\n", "$1 \\E \\Q .*\n", "word " * 20_000 + "\n" + "line\n" * 5_000, "x" * 300_000,
]


def expected(doc_id, text, grammar, seed=infill.SEED, rate=infill.RATE, spm=infill.SPM):
    t = text or ""
    us = re.findall(grammar.pattern(), t)
    assert "".join(us) == t
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(us)
    if not t or any(m in t for m in infill.MARKERS.values()) or h3 % 100 >= rate:
        return n, "plain", None, None, None, t
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(us[:lo]), "".join(us[lo:hi]), "".join(us[hi:])
    return (n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("name", sorted(infill.GRAMMARS))
def test_every_grammar_is_cut_and_restored_exactly(spark, name):
    grammar = infill.GRAMMARS[name]
    rows = [(k * 13 + j, t) for k, t in enumerate(TEXTS) for j in range(3)] + [(None, "null id\nof a text\n"), (7, TEXTS[10]), (7, TEXTS[10])]
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, units string").repartition(5)
    out = infill.transform(df, grammar=grammar, rate=80)
    got = out.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    want = sorted(map(repr, ((i, *expected(i, t, grammar, rate=80), t or "") for i, t in rows)))
    assert sorted(repr(tuple(r)) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_markers_of_ones_own_and_an_empty_table(spark):
    marks = {"P": "[pre]", "S": "[suf]", "M": "[mid]"}
    df = spark.createDataFrame([(k, f"a.b*[{k}]\nline <P>\nlast") for k in range(40)] + [(99, "holds [mid]\nx")], "doc_id long, text string")
    out = infill.transform(df, markers=marks).withColumn("back", infill.restored(F.col("output"), F.col("form"), marks))
    rows = {r.doc_id: r for r in out.collect()}
    assert all(r.back == t for (i, t) in df.collect() for r in [rows[i]])
    assert rows[99].form == "plain" and {r.form for i, r in rows.items() if i != 99} == {"psm", "spm"}
    empty = infill.transform(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n", "form", "prefix", "middle", "suffix", "output"]


def test_rate_of_nothing_leaves_texts_plain(spark):
    df = spark.createDataFrame([(k, "a\nb\n") for k in range(20)], "doc_id long, text string")
    assert {(r.form, r.output) for r in infill.transform(df, rate=0).collect()} == {("plain", "a\nb\n")}
