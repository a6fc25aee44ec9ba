"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

Templates are short notices, file headers and whole licence texts. Normalised, a text is its ASCII letters and digits in
lower case, words split by anything else, so comment marks and quotes fall away. Its segments are its lines, its blocks
of lines between blank ones and the whole text; besides, each template is compared with all windows of its own size over
the text's words, so that a notice within a line, or a licence below a copyright line in a comment, is found as well.
The Dice coefficient is 2 |common bigrams| / (|bigrams| + |the template's|), bigrams counted as often as they occur;
THRESHOLD and more is a match. A segment is named by its best template (ties: first by name). Of windows, one is
reported where no other matching window that overlaps it has more, is larger, starts earlier or has the first name, in
this order, and no matching segment touches its lines.

Exact bounds prune. By size: with |A| and |B| bigrams the coefficient is 2 min / (|A| + |B|) at most, so a template
is a candidate only for segments of t/(2-t) to (2-t)/t times its size. By words: a match shares more than t/(2-t) of
the template's bigrams, so it holds at least one of a few chosen words whose bigrams are the rest; a text without any
template's chosen words is never split. By bigrams: a text's bigrams that a template has at all, counted once for all
templates, bound what a segment or a window can share with it.

Nulls and empty texts have no licence; every input row gives one row, repeated rows too; an empty table gives none,
and without templates nothing is found. One-word segments count as one bigram of that word with nothing. Other columns,
whatever their names, are not read; without_notices() returns them as they are.
"""

from __future__ import annotations

import re
from collections import Counter
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, packed, session_of, table

THRESHOLD = 0.8
_SLACK = 1e-9  # far above the rounding of the bounds, which the coefficient itself then decides
#: Public licence notices and headers, by SPDX identifier; whole texts are the files in texts/.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "BSD-3-Clause": ["Released under the BSD License.", "Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    **{f"{kind.replace(' ', '-')}-4.0": [f"Licensed under {kind} 4.0."] for kind in ("CC BY", "CC BY-SA", "CC BY-NC", "CC BY-ND", "CC BY-NC-SA", "CC BY-NC-ND")},
}
_WORD = re.compile(r"[a-z0-9]+")


def whole_texts() -> dict[str, list[str]]:
    """The licences of texts/, by SPDX identifier; read on the driver."""
    return {f.name.removesuffix(".txt"): [f.read_text()] for f in sorted(files(__package__).joinpath("texts").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}


def all_templates() -> dict[str, list[str]]:
    out = whole_texts()
    for name, notices in NOTICES.items():
        out[name] = [*notices, f"SPDX-License-Identifier: {name}", *out.get(name, [])]
    return out


def bigrams(text: str) -> Counter:
    words = _WORD.findall(text.lower())
    return Counter(zip(words, words[1:] if len(words) > 1 else [""], strict=False))


def dice(a: Counter, b: Counter) -> float:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    size = a.total() + b.total()
    return 2 * sum(min(n, large[x]) for x, n in small.items() if x in large) / size if size else 0.0


def chosen_words(grams: Counter, threshold: float) -> list[str]:
    """Words whose bigrams are so many that a match can't do without all of them: long ones, those of most bigrams first."""
    spare = grams.total() * (1 - threshold / (2 - threshold)) + _SLACK
    of: Counter = Counter()
    for g, n in grams.items():
        for w in set(g) - {""}:
            of[w] += n
    out: set[str] = set()
    held = 0
    for w in sorted(of, key=lambda w: (-min(len(w), 7), -of[w], w)):
        if held > spare:
            break
        held += sum(n for g, n in grams.items() if w in g and not out & set(g))
        out.add(w)
    return sorted(out)


def _range_max(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The greatest of values[lo:hi] for each range, -1 for empty ones."""
    table = [values]
    while len(table[-1]) > 1 << (len(table) - 1):
        step = 1 << (len(table) - 1)
        table.append(np.maximum(table[-1], np.append(table[-1][step:], np.full(step, -1))))
    out = np.full(len(lo), -1)
    size = hi - lo
    for level, row in enumerate(table):
        some = np.flatnonzero((size >> level > 0) & (size >> (level + 1) == 0))
        out[some] = np.maximum(row[lo[some]], row[hi[some] - (1 << level)])
    return out


class Scanner:
    def __init__(self, templates: dict[str, list[str]], threshold: float):
        self.threshold = threshold
        self.templates = sorted(((name, bigrams(t)) for name, ts in templates.items() for t in ts if bigrams(t)), key=lambda x: (x[0], sorted(x[1].items())))
        words = sorted({w for _, g in self.templates for w in chosen_words(g, threshold)})
        self.any = "(?i)" + "|".join(words) if words else None
        self.sizes = np.array([g.total() for _, g in self.templates], np.int64)
        self.words: dict[str, int] = {}
        keys = [np.array([self._number(*g) for g in grams], np.int64) for _, grams in self.templates]
        self.keys = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]))
        # how often each template has each of all templates' bigrams
        self.counts = np.zeros((len(self.templates), len(self.keys)), np.int32)
        for row, k, (_, grams) in zip(self.counts, keys, self.templates, strict=True):
            row[np.searchsorted(self.keys, k)] = list(grams.values())

    def _number(self, a: str, b: str) -> int:
        return self.words.setdefault(a, len(self.words)) << 24 | self.words.setdefault(b, len(self.words))

    def best(self, segment: str) -> tuple[str, float] | None:
        t, grams = self.threshold, bigrams(segment)
        n, found = grams.total(), None
        for name, g in self.templates:
            m = g.total()
            if min(n, m) * (2 - t) + _SLACK >= t * max(n, m) and (d := dice(grams, g)) >= t and (found is None or d > found[1]):
                found = name, d
        return found

    def windows(self, at: np.ndarray, gram: np.ndarray, n: int) -> list[tuple[str, float, int, int]]:
        """(licence, score, first and last bigram) of the windows to report over n bigrams, from where (at) they are a template's and which (gram)."""
        t, cols = self.threshold, []
        for k in np.flatnonzero((self.counts[:, gram] > 0).sum(1) * 2 + _SLACK >= t * (self.sizes + np.minimum(self.sizes, n))).tolist():
            m = int(self.sizes[k])
            own = self.counts[k, gram] > 0
            g, p = gram[own], at[own]
            order = np.lexsort((p, g))
            g, p = g[order], p[order]
            # an occurrence counts in a window unless the template's share of its bigram stands before it in there
            j = np.arange(len(g)) - self.counts[k, g]
            before = np.where((j >= 0) & (g[np.maximum(j, 0)] == g), p[np.maximum(j, 0)], -1)
            rise = np.zeros(n + 2, np.int64)
            np.add.at(rise, np.maximum(p - m + 1, before + 1).clip(0), 1)
            np.add.at(rise, p + 1, -1)
            starts = np.unique(np.minimum(p, max(0, n - m)))
            score = 2 * np.cumsum(rise)[starts] / (m + min(m, n))
            some = score >= t
            if some.any():
                cols.append((score[some], starts[some], np.full(int(some.sum()), k)))
        if not cols:
            return []
        score, first, k = map(np.concatenate, zip(*cols, strict=True))
        last = np.minimum(first + self.sizes[k], n) - 1
        rank = np.empty(len(k), np.int64)
        rank[np.lexsort((-k, -first, self.sizes[k], score))] = np.arange(len(k))
        beaten = np.zeros(len(k), bool)
        for x in np.unique(k):  # windows of one template are in order of their starts and of their ends
            own = np.flatnonzero(k == x)
            best = _range_max(rank[own], np.searchsorted(last[own], first), np.searchsorted(first[own], last, "right"))
            beaten |= best > rank
        return [(self.templates[k[i]][0], float(score[i]), int(first[i]), int(last[i])) for i in np.flatnonzero(~beaten)]

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(licence, score, first line, last line) of each matching segment, lines before blocks before the whole, then of windows."""
        t, lines = self.threshold, text.split("\n")
        parts = [_WORD.findall(x) for x in text.lower().split("\n")]
        ends = np.cumsum([0, *map(len, parts)])  # words before each line
        ids = np.fromiter((self.words.get(w, -1) for p in parts for w in p), np.int64, int(ends[-1]))
        n = max(0, len(ids) - 1)
        both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        key = ids[both] << 24 | ids[both + 1] if len(both) else both
        gram = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        known = self.keys[gram] == key if len(self.keys) else np.zeros(0, bool)
        at, gram = both[known], gram[known]
        segments = [(k, k) for k in range(len(lines))]
        start = 0
        for k in range(len(lines) + 1):
            if k == len(lines) or not lines[k].strip():
                if k - start > 1:
                    segments.append((start, k - 1))
                start = k + 1
        if len(lines) > 1 and (0, len(lines) - 1) not in segments:
            segments.append((0, len(lines) - 1))
        a, b = (np.array(x) for x in zip(*segments, strict=True))
        size = ends[b + 1] - ends[a] - 1  # bigrams
        shared = np.searchsorted(at, ends[b + 1] - 1) - np.searchsorted(at, ends[a])  # those that any template has
        some = (size == 0) & ("" in self.words)  # only templates of one word match such
        for m in np.unique(self.sizes):
            some |= (np.minimum(size, m) * (2 - t) + _SLACK >= t * np.maximum(size, m)) & (2 * shared + _SLACK >= t * (size + m))
        out = []
        for k in np.flatnonzero(some).tolist():
            x, y = segments[k]
            if got := self.best("\n".join(lines[x : y + 1])):
                out.append((*got, x, y))
        taken = np.zeros(len(lines) + 1, np.int64)
        for *_, x, y in out:
            taken[x] += 1
            taken[y + 1] -= 1
        taken = np.concatenate(([0], np.cumsum(np.cumsum(taken) > 0)))  # lines of matching segments before each line
        for name, s, x, y in self.windows(at, gram, n) if n else ():
            x, y = (int(np.searchsorted(ends, z, "right")) - 1 for z in (x, y + 1))  # the lines of its first and last word
            if taken[y + 1] == taken[x]:
                out.append((name, s, x, y))
        return out


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and found: ARRAY<STRUCT<license, score, first_line, last_line>> for every row of docs. templates: all_templates() by default."""
    found = _found(docs, templates, threshold, text)
    return docs.select(col(doc_id).alias("doc_id"), found.alias("found"))


def without_notices(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """docs, the text without the lines of the licences that it holds; of segments within each other those of the higher score."""
    inner = docs.select(packed(docs), _found(docs, templates, threshold, text).alias("found"))
    better = lambda f: F.exists("found", lambda g: (g["first_line"] >= f["first_line"]) & (g["last_line"] <= f["last_line"]) & (g["score"] > f["score"]))
    inner = inner.withColumn("found", F.filter("found", lambda f: ~better(f)))
    kept = F.filter(F.split(F.col("row")[text], "\n"), lambda x, i: ~F.exists("found", lambda f: (f["first_line"] <= i) & (i <= f["last_line"])))
    return inner.select(*((F.array_join(kept, "\n") if c == text else F.col("row")[c]).alias(c) for c in docs.columns))


def _found(docs: DataFrame, templates: dict[str, list[str]] | None, threshold: float, text: str):
    spark = session_of(docs)
    sent = spark.sparkContext.broadcast(Scanner(all_templates() if templates is None else templates, threshold))  # of the templates' size
    item = pa.list_(pa.struct([("license", pa.string()), ("score", pa.float64()), ("first_line", pa.int32()), ("last_line", pa.int32())]))

    @F.arrow_udf("array<struct<license:string,score:double,first_line:int,last_line:int>>")
    def run(texts: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        scanner, found = sent.value, [[] for _ in range(len(texts))]
        some = pc.match_substring_regex(texts, scanner.any).to_numpy(zero_copy_only=False).nonzero()[0] if scanner.any else ()
        for k in some:
            found[k] = [{"license": n, "score": round(s, 6), "first_line": a, "last_line": b} for n, s, a, b in scanner.scan(texts[int(k)].as_py())]
        return pa.array(found, item)

    return run(F.coalesce(col(text), F.lit("")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_segments, licenses (distinct, sorted, comma-joined), best_score (null without a match)."""
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["license"]))), ",")
    return scan(table(spark, sf_dir, "documents")).select("doc_id", F.size("found").cast("long").alias("n_segments"), names.alias("licenses"), F.array_max(F.transform("found", lambda x: x["score"])).alias("best_score"))


def sql() -> str:
    """DuckDB's equivalent without the bounds by words."""
    quoted = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, ts in all_templates().items() for t in ts)
    grams = "list_transform(range(1, greatest(len({w}), 2)), lambda k: {w}[k] || ' ' || coalesce({w}[k + 1], ''))"
    words = "list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda x: x <> '')"
    return f"""
with lines as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
blank as (select doc_id, l, list_filter(range(0, len(l) + 2), lambda k: k = 0 or k = len(l) + 1 or length(regexp_replace(l[k], '\\s', '', 'g')) = 0) as z from lines),
spans as (
  select doc_id, l, unnest(range(1, len(l) + 1)) as a, unnest(range(1, len(l) + 1)) as b from lines
  union select doc_id, l, a, b from (select doc_id, l, unnest(list_transform(range(1, len(z)), lambda k: z[k] + 1)) as a, unnest(list_transform(range(1, len(z)), lambda k: z[k + 1] - 1)) as b from blank) where b > a
  union select doc_id, l, 1, len(l) from lines),
seg as (select doc_id, a, b, {words.format(x="array_to_string(l[a:b], chr(10))")} as w from spans),
g as (select *, {grams.format(w='w')} as grams from seg where len(w) > 0),
t as (select name, body, {words.format(x="body")} as w from (values {quoted}) v(name, body)),
tg as (select name, row_number() over (order by name, body) as k, {grams.format(w='w')} as grams from t),
tb as (select k, name, len(grams) as n, unnest(grams) as x from tg),
tc as (select k, name, n, x, count(*) as c from tb group by all),
gx as (select doc_id, a, b, len(grams) as n, unnest(grams) as x from g),
gb as (select doc_id, a, b, n, x, count(*) as c from gx group by all),
d as (select doc_id, a, b, k, name, 2 * sum(least(gb.c, tc.c)) / (gb.n + tc.n) as score from gb join tc on gb.x = tc.x and least(gb.n, tc.n) * (2 - {THRESHOLD}) >= {THRESHOLD} * greatest(gb.n, tc.n) group by doc_id, a, b, k, name, gb.n, tc.n having 2 * sum(least(gb.c, tc.c)) / (gb.n + tc.n) >= {THRESHOLD}),
best as (select doc_id, a, b, name, score from d qualify row_number() over (partition by doc_id, a, b order by score desc, name, k) = 1),
wl as (select doc_id, unnest(range(1, len(l) + 1)) as line, unnest(list_transform(l, lambda y: {words.format(x="y")})) as w from lines),
ww as (select doc_id, line, unnest(w) as word, unnest(range(0, len(w))) as j from wl),
wp as (select doc_id, line, word, row_number() over (partition by doc_id order by line, j) - 1 as p from ww),
wg as (select doc_id, p, word || ' ' || lead(word) over (partition by doc_id order by p) as x, count(*) over (partition by doc_id) - 1 as n from wp),
occ as (select doc_id, p, x, wg.n, k, name, tc.n as m, c, row_number() over (partition by doc_id, k, x order by p) as r from wg join tc using (x)),
enough as (select doc_id, k from occ group by doc_id, k, n, m having 2 * count(*) >= {THRESHOLD} * (m + least(m, n))),
own as (select occ.* from occ semi join enough using (doc_id, k)),
sp as (select o.doc_id, o.k, o.name, o.n, o.m, o.p, greatest(o.p - o.m + 1, coalesce(q.p, -1) + 1, 0) as lo from own o left join own q on o.doc_id = q.doc_id and o.k = q.k and o.x = q.x and q.r = o.r - o.c),
st as (select distinct doc_id, k, name, n, m, least(p, greatest(0, n - m)) as s from sp),
win as (select st.doc_id, st.k, st.name, st.m, st.s, least(st.s + st.m, st.n) - 1 as e, 2 * count(*) / (st.m + least(st.m, st.n)) as score from st join sp on st.doc_id = sp.doc_id and st.k = sp.k and sp.lo <= st.s and st.s <= sp.p group by st.doc_id, st.k, st.name, st.m, st.s, st.n having 2 * count(*) / (st.m + least(st.m, st.n)) >= {THRESHOLD}),
peaks as (select * from win w where not exists (select 1 from win v where v.doc_id = w.doc_id and v.s <= w.e and w.s <= v.e and (v.score > w.score or (v.score = w.score and (v.m > w.m or (v.m = w.m and (v.s < w.s or (v.s = w.s and v.k < w.k)))))))),
tl as (select w.doc_id, w.name, w.score, x.line as a, y.line as b from peaks w join wp x on x.doc_id = w.doc_id and x.p = w.s join wp y on y.doc_id = w.doc_id and y.p = w.e + 1),
allof as (select doc_id, name, score from best union all select doc_id, name, score from tl where not exists (select 1 from best where best.doc_id = tl.doc_id and best.a <= tl.b and tl.a <= best.b))
select documents.doc_id, count(allof.name)::bigint as n_segments, coalesce(string_agg(distinct allof.name, ',' order by allof.name), '') as licenses, max(round(allof.score, 6)) as best_score
from documents left join allof on documents.doc_id = allof.doc_id group by documents.doc_id
"""
