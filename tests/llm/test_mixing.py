import math
from collections import Counter

from blockloom.llm import mixing
from tests.duck import connect, duck_rows, spark_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], SCHEMA)


def rows(n=3000):
    return [(k, f"t{k}", "hot" if k % 3 else f"s{k % 30}") for k in range(n)] + [(None, "n", None), (n, None, "rare"), (n + 1, "", "rare")]


def test_agrees_with_sql(spark):
    df = frame(spark, rows())
    con = connect()
    con.register("given", df.toPandas().astype({"doc_id": "Int64"}))
    assert spark_rows(mixing.mix(df)) == duck_rows(con, mixing.sql("given"))


def test_reaches_targets_and_repeats_itself(spark):
    df = frame(spark, rows())
    targets = {"hot": 0.5, "s0": 0.3, "s3": 0.2, "rare": 0.0, None: 0.0}
    a = mixing.mix(df, targets).collect()
    b = mixing.mix(df.repartition(13), targets).collect()
    assert Counter(a) == Counter(b)
    n = Counter(r.source for r in a)
    total = len(rows())
    for s, share in targets.items():
        assert abs(n[s] - share * total) <= 5 * math.sqrt(total)
    assert set(n) == {"hot", "s0", "s3"}
    assert all(0 < r.copy <= r.copies for r in a)


def test_rates_above_a_part(spark):
    """A mean far above PART is a sum of parts, each inverted on its own."""
    df = frame(spark, [(k, "a", "big") for k in range(2000)] + [(9999, "b", "small")])
    got = mixing.mix(df, {"small": 1.0}).collect()
    assert abs(len(got) - 2001) < 5 * math.sqrt(2001) and {r.copy for r in got} == set(range(1, len(got) + 1))


def test_salted_join_gives_the_same(spark, monkeypatch):
    df = frame(spark, rows(500))
    want = Counter(mixing.mix(df).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert Counter(mixing.mix(df).collect()) == want


def test_poisson_frequencies(spark):
    df = frame(spark, [(k, "a", "x") for k in range(20_000)])
    n = Counter(r.copies for r in mixing.mix(df, {"x": 1.0}).dropDuplicates(["doc_id"]).collect())
    for k in range(1, 5):
        want = 20_000 * math.exp(-1) / math.factorial(k)
        assert abs(n[k] - want) < 5 * math.sqrt(want)


def test_empty_and_clashing(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    names = "of id row n w parts mean cdf salt salt2 _s _cdf _parts _id a.b".split()
    df = frame(spark, rows(200)).selectExpr("*", "'x' as Copies", *(f"'{n}' as `{n}`" for n in names))
    out = mixing.mix(df)
    assert out.columns == [*df.columns[:5], *names, *mixing.ADDED] and dict(out.dtypes)["copies"] == "int"
    got = out.collect()
    assert all(r[n] == n for r in got for n in names)
    key = lambda r: (r.doc_id, r.text, r.source, r.copy, r.copies, r.shuffle_key)
    assert Counter(map(key, got)) == Counter(map(key, mixing.mix(frame(spark, rows(200))).collect()))
