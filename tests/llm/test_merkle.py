"""The manifest against a plain tree, whatever the partitions; proofs that verify, and changes that don't."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from blockloom.llm import merkle

FIELDS = merkle.FIELDS
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, part int, grp string"


def h(parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def climb(leaves, fanout):
    """The root, and each leaf's siblings from below upwards with its places."""
    proofs, where, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for k, at in enumerate(where):
            run = nodes[at // fanout * fanout : (at // fanout + 1) * fanout]
            proofs[k].append((at % fanout, run[: at % fanout] + run[at % fanout + 1 :]))
            where[k] = at // fanout
        nodes = [h(nodes[k : k + fanout]) for k in range(0, len(nodes), fanout)]
    return nodes[0], proofs


def fold(digest, proof):
    for place, others in proof:
        digest = h([*others[:place], digest, *others[place:]])
    return digest


def plain(rows, fanout=16):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: x[:3])
        trees[s] = climb([x[2] for x in groups[s]], fanout)
    root, tops = climb([trees[s][0] for s in names], fanout) if names else ("", [])
    out = []
    for s, top in zip(names, tops, strict=True):
        for x, own in zip(groups[s], trees[s][1], strict=True):
            r, proof = x[3], own + top
            low = zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 5 == 0 and r[4] is not None
            claim = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))) if low else x[2]
            folded = fold(claim, proof)
            out.append((r[0], x[2], trees[s][0], root, h(d for _, o in proof for d in o), folded, folded == root))
    return sorted(map(repr, out))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, "=hot") for r in rows], SCHEMA).repartition(5)


def got(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def made():
    rows = [(k, "hot", "en", 3, f"Text {k}") for k in range(700)] + [(k, f"src{k % 40}", None, None, f"ÄB c{k}") for k in range(700, 900)]
    rows += [(None, "hot", None, None, None), (None, None, None, None, None), (5, None, "en", 1, ""), (5, None, "en", 1, ""), (7, "hot", "en", 3, "Another text of id 7"), (-3, "Ünï", "de", 9, "X" * 100_000), (8, "", "fr", 0, "a:b-")]
    return rows + [(900, "same", "en", 1, "Repeated row")] * 90


@pytest.mark.parametrize(("part_rows", "fanout"), [(60, 16), (9, 2)])
def test_agrees_with_a_plain_tree(spark, part_rows, fanout):
    rows = made() if part_rows > 10 else made()[780:]
    df = frame(spark, rows)
    assert got(merkle.manifest(df, claimed=merkle.tampered(), part_rows=part_rows, fanout=fanout)) == plain(rows, fanout)


@pytest.mark.parametrize("n", [0, 1, 16, 257])
def test_sizes_at_the_borders_of_runs(spark, n):
    rows = [(k, "a", "en", k, f"T{k}") for k in range(n)]
    assert got(merkle.manifest(frame(spark, rows), claimed=merkle.tampered(), part_rows=20)) == plain(rows)


def test_proofs_are_returned_and_changes_are_found(spark):
    rows = [(k, f"s{k % 3}", "en", k, f"T{k}") for k in range(120)]
    df = frame(spark, rows)
    proved = merkle.manifest(df, proofs=True, part_rows=25)
    out = proved.collect()
    assert all(r.verified and fold(r.leaf, [tuple(x) for x in r.proof]) == r.root for r in out)
    root = out[0].root
    told = proved.join(df.select("doc_id", *(F.col(c) for c in FIELDS[1:])), "doc_id")
    ok = told.select(merkle.verified(told, merkle.leaf_of([F.col(c) for c in FIELDS]), root).alias("ok")).collect()
    assert len(ok) == 120 and all(r.ok for r in ok)
    changed = told.select(merkle.verified(told, merkle.leaf_of([F.lit("de") if c == "lang" else F.col(c) for c in FIELDS]), root).alias("ok")).collect()
    assert not any(r.ok for r in changed)


def test_a_tables_order_doesnt_matter_and_its_rows_do(spark):
    rows = made()[:300]
    root = lambda x: {r.root for r in merkle.manifest(frame(spark, x), part_rows=40).collect()}
    assert root(rows) == root(rows[::-1]) and len(root(rows)) == 1
    assert root(rows) != root(rows[:-1])
