from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from blockloom.llm import licenses

SCANNER = licenses.Scanner(licenses.NOTICES, licenses.THRESHOLD)
ALL = licenses.Scanner(licenses.all_templates(), licenses.THRESHOLD)


def plain(segment):
    """The best template without bounds."""
    a, best = licenses.bigrams(segment), None
    for name, g in sorted((n, licenses.bigrams(t)) for n, ts in licenses.NOTICES.items() for t in ts):
        d = 2 * sum((a & g).values()) / (a.total() + g.total()) if a else 0
        if d >= licenses.THRESHOLD and (best is None or d > best[1]):
            best = name, d
    return best


WORDS = sorted({w for ts in licenses.NOTICES.values() for t in ts for w in t.split()}) + ["foo"]


@settings(max_examples=300, deadline=None)
@given(st.sampled_from([t for ts in licenses.NOTICES.values() for t in ts]), st.lists(st.tuples(st.floats(0, 1), st.sampled_from(WORDS)), max_size=4))
def test_bounds_lose_nothing(template, edits):
    words = template.split()
    for at, w in edits:
        words[int(at * (len(words) - 1))] = w
    text = " ".join(words)
    assert SCANNER.best(text) == plain(text)
    got = SCANNER.scan(text)
    assert [x[:2] for x in got][:1] == ([plain(text)] if plain(text) else [x[:2] for x in got][:1])


def test_segments():
    text = "prose " * 60 + "\nReleased under the MIT License.\n\nThis program is free software: you can redistribute it and/or modify it under the terms of the GNU\nGeneral Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)\nany later version.\n\nLICENSED!! UNDER!! THE!! APACHE!! LICENSE, VERSION!! 2.0."
    assert [(n, a, b) for n, _, a, b in SCANNER.scan(text)] == [("MIT", 1, 1), ("Apache-2.0", 7, 7), ("GPL-3.0", 3, 5)]


def test_frames(spark):
    rows = [(1, None), (2, ""), (3, "Licensed under CC BY-NC 4.0."), (3, "Licensed under CC BY-NC 4.0."), (None, "license " * 50_000), (4, "license")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, found int")
    got = Counter((r.doc_id, *(x.license for x in r.found)) for r in licenses.scan(df).collect())
    assert got == Counter({(1,): 1, (2,): 1, (3, "CC-BY-NC-4.0"): 2, (None,): 1, (4,): 1})
    assert licenses.scan(df.limit(0)).count() == 0


def plain_windows(scanner, text):
    """All windows of every template's size, one by one."""
    words = licenses._WORD.findall(text.lower())
    n, found = max(0, len(words) - 1), []
    for k, (name, g) in enumerate(scanner.templates):
        m = g.total()
        for a in range(max(1, n - m + 1)):
            own = Counter(zip(words[a : a + m], words[a + 1 : a + m + 1], strict=False))
            if own and (d := 2 * sum((own & g).values()) / (own.total() + m)) >= scanner.threshold:
                found.append((d, m, -a, -k, a, a + own.total() - 1, name))
    return found


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([t for ts in licenses.NOTICES.values() for t in ts]), st.lists(st.tuples(st.floats(0, 1), st.sampled_from(WORDS)), max_size=3), st.integers(0, 6)), max_size=4))
def test_windows_against_every_window(parts):
    text = []
    for template, edits, gap in parts:
        words = template.split()
        for at, w in edits:
            words[int(at * (len(words) - 1))] = w
        text += words + ["foo", "the", "license", "of", "this", "bar"][:gap]
    text = " ".join(text)
    found = plain_windows(SCANNER, text)
    words = licenses._WORD.findall(text.lower())
    ids = np.array([SCANNER.words.get(w, -1) for w in words], np.int64)
    both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    key = ids[both] << 24 | ids[both + 1] if len(both) else both
    known = np.isin(key, SCANNER.keys)
    got = SCANNER.windows(both[known], np.searchsorted(SCANNER.keys, key[known]), max(0, len(words) - 1)) if len(words) > 1 else []
    # the best window of all is reported with its score; every report is a matching window that no better one overlaps
    if len(words) > 1:
        scores = {(x[-1], x[4], x[5]): x[0] for x in found}
        assert all(abs(scores[n, a, b] - s) < 1e-12 for n, s, a, b in got)
        assert bool(got) == bool(found) and (not found or abs(max(x[1] for x in got) - max(x[0] for x in found)) < 1e-12)
        assert all(a2 > b1 or a1 > b2 for i, (_, _, a1, b1) in enumerate(got) for _, _, a2, b2 in got[:i])


def test_whole_licences_and_notices_within_lines():
    names = licenses.whole_texts()
    assert {"MIT", "Apache-2.0", "GPL-3.0", "BSD-3-Clause", "MPL-2.0"} <= names.keys()
    for name, (body,) in names.items():
        lines = body.split("\n")
        commented = "\n".join(["/*", " * Copyright 2020 Foo Inc. and others", " *", *(f" * {x}" for x in lines), " */", "int main() { return 0; }"] + ["code();"] * 30)
        assert name in {x[0] for x in ALL.scan(commented)}, name
        hashed = "import os\n" + "\n".join(f"# {x}" for x in lines) + "\nprint('prose that follows')" * 50
        assert name in {x[0] for x in ALL.scan(hashed)}, name
    for line, name in (
        ("Many thanks to the authors of foo. Licensed under the MIT License. It does what it should.", "MIT"),
        ("Copyright 2020 Foo Inc. Released under the MIT License.", "MIT"),
        ("This file is Released under the MIT License.", "MIT"),
        ("x = 1 # Licensed under the Apache License, Version 2.0. see LICENSE", "Apache-2.0"),
    ):
        assert {x[0] for x in ALL.scan(f"some text\n{line}\nmore text")} == {name}, line
    prose = "The license to print money is not a license at all. The software of this house is provided with tea, and the conditions are met by few."
    assert ALL.scan(prose) == []


def test_ties_and_no_templates(spark):
    twice = licenses.Scanner({"B": ["one two three four"], "A": ["one two three four"], "C": ["one"]}, 0.8)
    assert twice.scan("x\none two three four\none") == [("A", 1.0, 1, 1), ("C", 1.0, 2, 2)]
    assert [x[0] for x in twice.scan("zero zero one two three four five five five")] == ["A"]
    df = spark.createDataFrame([(1, "Released under the MIT License.", "f"), (2, None, "g")], "doc_id long, text string, found string")
    assert [r.found for r in licenses.scan(df, {}).orderBy("doc_id").collect()] == [[], []]
    assert [r.found for r in licenses.scan(df, {"E": ["", "--"]}).collect()] == [[], []]


def test_without_notices(spark):
    rows = [(1, "head\nReleased under the MIT License.\ntail", 7), (2, None, 8), (3, "", 9), (4, "nothing here", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int")
    assert sorted(map(tuple, licenses.without_notices(df).collect())) == [(1, "head\ntail", 7), (2, None, 8), (3, "", 9), (4, "nothing here", 1)]


def test_sql_on_licences_of_all_kinds():
    import duckdb
    import pandas as pd

    bodies = [b for (b,) in licenses.whole_texts().values()]
    texts = [None, "", "one", "Released under the MIT License.\n\nfoo"] + ["x y z. " + t + " and more words" for ts in licenses.NOTICES.values() for t in ts]
    texts += ["# " + b.replace("\n", "\n# ") for b in bodies] + [b[: len(b) * 9 // 10] for b in bodies] + ["\n\n".join(bodies[3:8]), "Released under the MIT License. " * 5]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    got = {r[0]: r[1:] for r in con.sql(licenses.sql()).fetchall()}
    for k, t in enumerate(texts):
        found = ALL.scan(t or "")
        assert got[k] == (len(found), ",".join(sorted({x[0] for x in found})), max((round(x[1], 6) for x in found), default=None)), (t or "")[:80]
