"""The pipeline against a plain version of each stage on a small corpus."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from blockloom.llm import decontamination, mixing, quality, sharding, simhash
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_simhash import plain as fingerprint
from tests.llm.test_similarity import shingles

SF = "/root/testdata/sf0.001"


def grouped(ids, alike):
    """Each row's least id reachable by pairs that are alike."""
    root = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if root[i] != root[j] and alike(i, j):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return [min(ids[k] for k in range(len(ids)) if root[k] == r) for r in root]


def test_each_stage_does_what_a_plain_version_does(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    # 1: the model, scored row by row in numpy
    model = quality.train(docs, labels)
    rows = quality.statistics(docs).select("row.doc_id", "q.*").collect()
    score = dict(zip([r[0] for r in rows], model(np.array([tuple(r)[1:] for r in rows], float)), strict=True))
    good = P.good_quality(spark, docs, SF)
    assert {r.doc_id for r in good.collect()} == {i for i, s in score.items() if s >= quality.KEEP_FROM}
    # 2: all pairs by fingerprint and by exact similarity
    texts = {r.doc_id: r.text for r in good.collect()}
    ids = sorted(texts)
    fps = [fingerprint(texts[i], P.SHINGLE_WORDS) for i in ids]
    sets = [shingles(texts[i]) for i in ids]
    alike = lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3 or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    one = P.one_of_each_group(spark, good, SF)
    kept = {r.doc_id for r in one.collect()}
    assert kept == set(grouped(ids, alike))
    assert len(kept) < len(ids)
    # 3: alignment of everything with everything
    texts = {r.doc_id: r.text for r in one.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()][:8]
    some = [(i, t) for i, t in texts.items() if len(t) < 2500][:60]
    got = {r.doc_id for r in decontamination.contaminations(spark.createDataFrame(some, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {d for d, _ in leaks(some, items)}
    clean = P.without_test_items(spark, one, SF)
    held = {r.doc_id for r in decontamination.contaminations(one, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == texts.keys() - held
    # 4 and 5 have SQL of their own
    mix = P.mixed(spark, clean, SF)
    assert mix.columns == docs.columns
    assert Counter(r.doc_id for r in mix.collect()) == Counter(r.doc_id for r in mixing.mix(clean).collect())
    out = P.sharded(spark, mix, SF)
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in mix.collect())
    # and run() is these stages
    assert Counter(map(tuple, P.run(spark, SF).collect())) == Counter(map(tuple, out.collect()))
    assert out.columns == [*docs.columns, *sharding.ADDED]


def test_one_row_of_repeated_rows_stays(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "quite another text that says other things"), (None, "a b c d e f g"), (None, "words only here for a null id"), (None, "words only here for a null id"), (5, None), (6, "")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, root int")
    got = Counter((r.doc_id, r.text) for r in simhash.deduplicate(df).collect())
    assert got == Counter({(1, "a b c d e f g"): 1, (1, rows[2][1]): 1, (None, rows[4][1]): 1, (5, None): 1})
    assert simhash.deduplicate(df.limit(0)).count() == 0


def test_columns_named_like_internal_ones_are_kept(spark):
    """Every stage on documents with extra columns whose names operators use within."""
    names = "row h b cell cell0 leaf0 leaf w l n q t key kept kept_key k of id source2 cdf parts mean salt salt2 root fp _h _b _q _w _l _n _t _k _key _kept _s _cdf _parts _id label page part at off c open".split()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wide = docs.select("*", *(F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names))
    for name, stage in P.STAGES:
        got = stage(spark, wide, SF)
        assert got.columns[: len(wide.columns)] == wide.columns, name
        rows = got.collect()
        assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names), name
        assert Counter(tuple(r[c] for c in docs.columns) for r in rows) == Counter(tuple(r[c] for c in docs.columns) for r in stage(spark, docs, SF).collect()), name


def test_every_stage_on_empty_and_odd_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    empty, odd = docs.limit(0), spark.createDataFrame([(None, None, None, None, None), (None, None, None, None, None), (1, "", "en", None, 0), (1, None, "en", "a", 0), (2, "word", None, "a", 4)], docs.schema)
    for name, stage in P.STAGES:
        got = stage(spark, empty, SF)
        assert got.count() == 0 and got.columns[:5] == docs.columns, name
        rows = [tuple(r)[:5] for r in stage(spark, odd, SF).collect()]
        assert set(rows) <= {tuple(r) for r in odd.collect()}, name
    # equal texts are one group, a null text being an empty one, and ids come before nulls
    assert sorted((r.doc_id, r.text or "") for r in P.one_of_each_group(spark, odd, SF).collect()) == [(1, ""), (2, "word")]
    assert P.without_test_items(spark, odd, SF).count() == 5 and P.sharded(spark, odd, SF).count() == 5
