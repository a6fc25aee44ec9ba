"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score.

Base kinds are email, ip, card (Luhn) and phone; the method adds iban (mod 97), secret (keys, tokens and passwords: by
the form that their issuers give them, or a value assigned to such a name whose entropy is that of a random one) and,
where a context word stands nearby, ssn and dob. A span that fails its check is dropped and not retried, but
of an IBAN all ends are tried, the longest first. Offsets are code points, ends exclusive. All scans
are linear in the text: runs are matched possessively and local parts of addresses are found from their "@".

Nulls are empty texts, which have no spans; every input row gives one row, repeated rows too; an empty table gives none.
Of secrets that overlap the first is taken; a value assigned to a name counts only with a digit and a letter in it, so a
password of letters alone isn't found. No span has a longest length. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, session_of, table

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "dob", "secret")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Where an IBAN may start, and one character more of it; its end is tried by _ibans.
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
_IBAN_NEXT = re.compile(r" ?[A-Z0-9]")
#: An IBAN's length by country. Of other countries any of 15 to 34 that passes is taken.
IBAN_LENGTH = {c: n for n, cs in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC MR SM",
    28: "AL AZ CY DO GT HU LB PL", 29: "BR PS QA UA", 30: "JO KW MU", 31: "MT", 32: "LC",
}.items() for c in cs.split()}
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_DOB = re.compile(r"(?<![0-9/-])(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9/-])")
#: The public forms of keys and tokens, by how they begin.
_ISSUED = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])|gh[opsur]_[A-Za-z0-9]{36,}+|github_pat_[A-Za-z0-9_]{22,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}+"
    r"|AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])|glpat-[A-Za-z0-9_-]{20,}+)|-----BEGIN [A-Z ]*PRIVATE KEY-----"
)
#: A token of three parts, dots between them: the first begins so, each has PART_CHARS more at least.
_TOKEN, PART_CHARS = "eyJ", 8
_PART = re.compile(r"[A-Za-z0-9_-]*+")
_ASSIGNED = re.compile(r"(?i:pass(?:word|wd|phrase)|pwd|secret|token|api[_-]?key|access[_-]?key|credential)s?[\"']?[ \t]*+[:=][ \t]*+[\"']?([^\s\"'<>,;]{8,}+)")
#: Bits a character that a value must have, of 8 characters and more; letters and digits both, or it is a word.
BITS = 2.5
#: Score before context; an added kind stays at KEEP and above.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "dob": 0.2, "secret": 0.8}
KEEP, NEAR, LIFT, DAMP = 0.5, 48, 0.35, 0.25
#: Words that speak for a kind, and words that speak against any.
CONTEXT = {
    "email": "mail email contact write e-mail",
    "ip": "ip host server address login",
    "card": "card visa mastercard amex credit payment",
    "phone": "phone call tel mobile fax telephone",
    "iban": "iban bank account transfer konto",
    "ssn": "ssn social security",
    "dob": "born birth birthday dob geboren",
    "secret": "password passwd secret token key credential login auth bearer",
}
AGAINST = "example sample test dummy version"
_FOR = {k: re.compile(r"\b(?:" + "|".join(map(re.escape, v.split())) + r")\b", re.I) for k, v in CONTEXT.items()}
_NOT = re.compile(r"\b(?:" + "|".join(AGAINST.split()) + r")\b", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, x in enumerate(reversed(digits)):
        d = ord(x) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(text: str) -> bool:
    """Of an IBAN without spaces: the remainder of the number it spells, its first four characters last, is 1."""
    rest = 0
    for x in text[4:] + text[:4]:
        v = int(x, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def _emails(text: str):
    at, free = text.find("@"), 0
    while at >= 0:
        run = text[free:at]
        left = at - (len(run) - len(run.rstrip(_LOCAL)))
        m = _DOMAIN.match(text, at + 1) if left < at else None
        if m:
            yield left, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 16 <= len(m[0]) and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum("0" <= x <= "9" for x in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return found


def _ibans(text: str):
    """Spans that end a word and pass mod 97, of their country's length, or else the longest of 15 to 34; spaces apart."""
    free = 0
    for m in _IBAN.finditer(text):
        if m.start() < free:
            continue
        at, ends, fixed = m.end(), [], IBAN_LENGTH.get(m[0][:2])
        for n in range(5, 35):
            x = _IBAN_NEXT.match(text, at)
            if not x:
                break
            at = x.end()
            after = text[at : at + 1]
            if (n == fixed if fixed else n >= 15) and not (after.isascii() and after.isalnum()):
                ends.append(at)
        for b in reversed(ends):
            if mod97(text[m.start() : b].replace(" ", "")):
                yield m.start(), b
                free = b
                break


def _random(value: str) -> bool:
    """Whether a value has the entropy of a random one."""
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return bits >= BITS and any(x.isdigit() for x in value) and any(x.isalpha() for x in value)


def _tokens(text: str):
    """Spans of tokens of three parts. A run of their characters is read once, however often a token may start within it."""
    at, end, whole = text.find(_TOKEN), -1, None
    while at >= 0:
        if at >= end:  # a new run: where it ends, and where the token ends if two more parts follow
            stops = [_PART.match(text, at).end()]
            while len(stops) < 3 and text[stops[-1] : stops[-1] + 1] == ".":
                stops.append(_PART.match(text, stops[-1] + 1).end())
            end = stops[0]
            whole = stops[2] if len(stops) == 3 and all(b - a > PART_CHARS for a, b in zip(stops, stops[1:], strict=False)) else None
        before = text[at - 1 : at]
        if whole and end - at - len(_TOKEN) >= PART_CHARS and not (before.isascii() and before.isalnum()):
            yield at, whole
            at, end = text.find(_TOKEN, whole), -1
        else:
            at = text.find(_TOKEN, at + 1)


#: What every match of the two patterns holds; a search for plain text costs far less than theirs.
_ISSUED_HAS = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "ghu_", "ghr_", "github_pat_", "xox", "k_live_", "k_test_", "AIza", "glpat-", "PRIVATE KEY")
_ASSIGNED_HAS = ("pass", "pwd", "secret", "token", "key", "credential")


def _secrets(text: str):
    free, low = 0, text.lower()
    found = [m.span() for m in _ISSUED.finditer(text)] if any(x in text for x in _ISSUED_HAS) else []
    found += _tokens(text)
    if any(x in low for x in _ASSIGNED_HAS):
        found += [m.span(1) for m in _ASSIGNED.finditer(text) if _random(m[1])]
    for a, b in sorted(found):
        if a >= free:
            yield a, b
            free = b


def _score(kind: str, text: str, a: int, b: int) -> float:
    around = text[max(0, a - NEAR) : a] + " " + text[b : b + NEAR]
    return round(min(1.0, max(0.0, PRIOR[kind] + LIFT * bool(_FOR[kind].search(around)) - DAMP * bool(_NOT.search(around)))), 4)


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), base kinds first, then by start."""
    out = [(k, a, b, _score(k, text, a, b)) for k, a, b in base_spans(text)]
    added = [("iban", a, b) for a, b in _ibans(text)]
    added += [("secret", a, b) for a, b in _secrets(text)]
    added += [(k, *m.span()) for k, pattern in (("ssn", _SSN), ("dob", _DOB)) for m in pattern.finditer(text)]
    for kind, a, b in added:
        if (s := _score(kind, text, a, b)) >= KEEP:
            out.append((kind, a, b, s))
    return out


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and found: ARRAY<STRUCT<kind, start, end, score, text>> for every row of docs."""
    session_of(docs)
    slim = docs.select(col(doc_id).alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("text", pa.string())]))

    def run(batches):
        for batch in batches:
            got = [[(k, a, b, s, t[a:b]) for k, a, b, s in spans(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([[dict(zip(("kind", "start", "end", "score", "text"), x, strict=True)) for x in row] for row in got], item)], names=["doc_id", "found"])

    return slim.mapInArrow(run, f"doc_id {kind}, found array<struct<kind:string,start:bigint,end:bigint,score:double,text:string>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    said = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    n = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    scores = F.array_join(F.transform("found", lambda x: x["score"].cast("string")), ",").alias("scores")
    return out.select("doc_id", *map(n, BASE), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("found")).alias("spans"), scores, *map(n, ADDED))


def base_sha256(text: str) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(text)).encode()).hexdigest()
