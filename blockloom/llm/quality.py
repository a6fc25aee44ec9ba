"""Quality classifier: a sparse rule ensemble over text statistics, compiled to Spark columns.

Statistics of the whole text are DataFrame expressions. Shallow trees, grown in turn on what the ones before left
unexplained, give paths; each path is a conjunctive rule; a lasso logistic regression keeps a few rules. The score is a
column: the logistic of the sum of the weights of the rules that hold. Training takes labelled rows whose id's crc32 isn't held out,
at most MAX_ROWS of them, by least hash of the id: a bounded sample, as labels only steer the fit. Only statistics
reach the driver, never texts.

Nulls are empty texts, which have statistics of 0 and a score like any other. Null or repeated labels: nulls are left
out, repeats count as often as they occur. With one label only or none, or where no statistic parts the labels (equal
texts, say), the score is the label's share, or 0.5. Empty table: empty result. Ties in the sample go by id's hash, then
label, then statistics. Other columns, whatever their names, are returned as they are, but score and predicted are
replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, packed, table

MAX_ROWS = 20_000
TREES, DEPTH, CUTS, MIN_LEAF, L1, STEPS = 24, 3, 32, 5, 3e-4, 600
KEEP_FROM = 0.7
STATISTICS = (
    "log_words", "word_length", "richness", "repeats", "upper", "digits", "symbols", "marks", "bars", "stops", "line_length", "distinct_lines", "long_words", "short_words",
)
#: Characters that are counted as symbols, as a pattern's class.
SYMBOLS = r"*$#%&@^~<>{}\[\]=+_\\/"


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """row, a struct of all columns of docs, and q, a struct of STATISTICS, mostly shares of characters, words or lines."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    of = lambda kind: F.regexp_count("t", F.lit(f"[{kind}]"))
    out = docs.select(packed(docs), F.coalesce(col(text), F.lit("")).alias("t"))
    out = out.withColumns({"w": F.filter(F.split("t", r"\s+"), lambda x: x != ""), "l": F.filter(F.split("t", r"\n"), lambda x: x != ""), "n": F.length("t")})
    w, n, words, lines = F.col("w"), F.col("n"), F.size("w"), F.size("l")
    found = F.struct(
        F.log1p(words.cast("double")).alias("log_words"),
        share(n, words).alias("word_length"),
        # of distinct words, by logarithms, as their share falls with a text's length
        share(F.log1p(F.size(F.array_distinct(w)).cast("double")), F.log1p(words.cast("double"))).alias("richness"),
        share(F.size(F.filter(w, lambda x, i: x == F.get(w, i + 1))), words).alias("repeats"),
        share(of(r"\p{Lu}"), n).alias("upper"),
        share(of("0-9"), n).alias("digits"),
        share(of(SYMBOLS), n).alias("symbols"),
        share(of("!?"), n).alias("marks"),
        share(of("|"), n).alias("bars"),
        share(of(".,;:"), words).alias("stops"),
        share(n, lines).alias("line_length"),
        share(F.size(F.array_distinct("l")), lines).alias("distinct_lines"),
        share(F.size(F.filter(w, lambda x: F.length(x) > 12)), words).alias("long_words"),
        share(F.size(F.filter(w, lambda x: F.length(x) < 4)), words).alias("short_words"),
    )
    # a generator of one row: the optimizer neither repeats the statistics in each rule that reads them nor moves filters below them
    return out.select("row", F.explode(F.array(found)).alias("q"))


@dataclass(frozen=True)
class Rule:
    """All of (statistic, above?, cut)."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, above, cut in self.terms:
            out &= (x[:, k] > cut) == above
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for k, above, cut in self.terms:
            c = F.col(f"q.{STATISTICS[k]}")
            out = out & ((c > F.lit(cut)) if above else (c <= F.lit(cut)))
        return out


@dataclass(frozen=True)
class Model:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + sum((w * r.holds(x) for r, w in self.rules), np.zeros(len(x))))))


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, depth: int, path: tuple, out: list[tuple[Rule, float, np.ndarray]]) -> None:
    """Grows a tree on gradients; every node but the root becomes a rule with its Newton step; leaves carry their rows."""
    best = None
    if depth < DEPTH and len(rows) >= 2 * MIN_LEAF:
        gs, hs = g[rows], h[rows]
        whole = gs.sum() ** 2 / (hs.sum() + 1)
        for k, c in enumerate(cuts):
            if not len(c):
                continue
            b = np.searchsorted(c, x[rows, k], "left")  # how many cuts lie below
            n, sg, sh = (np.cumsum(np.bincount(b, v, len(c) + 1))[:-1] for v in (None, gs, hs))
            gain = sg**2 / (sh + 1) + (gs.sum() - sg) ** 2 / (hs.sum() - sh + 1) - whole
            gain[(n < MIN_LEAF) | (len(rows) - n < MIN_LEAF)] = 0
            j = int(gain.argmax())
            if gain[j] > 1e-6 and (best is None or gain[j] > best[0]):
                best = gain[j], k, c[j]
    if best:
        for above in (False, True):
            part = rows[(x[rows, best[1]] > best[2]) == above]
            _tree(x, g, h, cuts, part, depth + 1, (*path, (best[1], above, float(best[2]))), out)
    if path:
        out.append((Rule(path), 0.0 if best else float(g[rows].sum() / (h[rows].sum() + 1)), rows if not best else rows[:0]))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    share = float(y.mean()) if len(y) else 0.5
    if len(y) < 2 * MIN_LEAF or share in (0.0, 1.0):
        return Model(math.log((share + 1e-3) / (1 - share + 1e-3)), ())
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, CUTS + 1)[1:-1])) for k in range(x.shape[1])]
    # midpoints, so that a cut isn't a value that rows have
    cuts = [np.unique(np.array([(v + x[x[:, k] > v, k].min()) / 2 for v in c if (x[:, k] > v).any()])) for k, c in enumerate(cuts)]
    f, rules = np.full(len(y), math.log(share / (1 - share))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        found: list[tuple[Rule, float, np.ndarray]] = []
        _tree(x, y - p, p * (1 - p), cuts, np.arange(len(y)), 0, (), found)
        for rule, step, rows in found:
            rules[rule] = None
            f[rows] += 0.5 * step
    rules = list(rules)
    if not rules:
        return Model(math.log(share / (1 - share)), ())
    z = np.stack([r.holds(x) for r in rules], 1).astype(np.float64)
    # lasso logistic regression by accelerated proximal gradient steps; the bias has no penalty
    w, b = np.zeros(len(rules)), math.log(share / (1 - share))
    rate = 4 / (np.linalg.norm(z, 2) ** 2 / len(y) + 1)
    v, c, t = w.copy(), b, 1.0
    for _ in range(STEPS):
        e = 1 / (1 + np.exp(-(z @ v + c))) - y
        new = v - rate * (z.T @ e) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * L1, 0)
        new_b = c - rate * e.mean()
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return Model(float(b), tuple((r, float(k)) for r, k in zip(rules, w, strict=True) if k))


def training_sample(labels: DataFrame, target: str, doc_id: str, modulus: int, held: int, most: int) -> DataFrame:
    """At most `most` labelled rows (id, y, o: hash of the id) that aren't held out, by least hash of the id."""
    key = col(doc_id).cast("string")
    rows = labels.where(col(doc_id).isNotNull() & col(target).isNotNull() & (F.pmod(F.crc32(key), F.lit(modulus)) != held))
    return rows.select(col(doc_id).alias("id"), col(target).cast("double").alias("y"), F.md5(key).alias("o")).orderBy("o", "y").limit(most)


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", doc_id: str = "doc_id", text: str = "text", modulus: int = 4, held: int = 2, most: int = MAX_ROWS) -> Model:
    sample = training_sample(labels, target, doc_id, modulus, held, most)
    met = docs.select(col(doc_id).alias("id"), col(text).alias("text")).join(F.broadcast(sample), "id")  # bounded by most
    # a table that repeats ids could give more rows than the sample has
    rows = statistics(met).select("row.o", "row.y", "q.*").orderBy("o", "y", *STATISTICS).limit(2 * most).collect()
    data = np.array([tuple(r)[1:] for r in rows], np.float64).reshape(len(rows), len(STATISTICS) + 1)
    return fit(data[:, 1:], data[:, 0])


def classify(docs: DataFrame, model: Model, text: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """docs with score and predicted; columns of these names are replaced (but the text's is read first)."""
    keep = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    out = statistics(docs, text).select(*(F.col("row")[c].alias(c) for c in keep), model.score().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= keep_from).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = classify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2).alias("held_out"), "score", "predicted")
