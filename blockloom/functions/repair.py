"""Repair of models' JSON: what the JVM's expressions can't say, as Python over Arrow batches."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_TAG = re.compile(r"<(/?)(think|thinking)>", re.I)
_OPENS = re.compile(r"```(?:json)?\s*+\{")
_CLOSES = re.compile(r"\}\s*+```")
#: A string, or what is left of a text behind a quote that nothing ends: one scan, whatever is missing.
_STRING = re.compile(r'"((?:[^"\\]++|\\.)*+)("?)', re.S)
_FIELD = r'"{}":\s*+"((?:[^"\\]++|\\.)*+)"'


def without_thinking(text: str) -> str:
    """Without blocks of thought, each from its start mark to the next end mark of that name; those without an end stay."""
    tags = list(_TAG.finditer(text))
    ends: list[dict[str, re.Match]] = [{}]
    for m in reversed(tags):  # for each tag the next end mark of either name from it on
        ends.append({**ends[-1], m[2].lower(): m} if m[1] else ends[-1])
    ends.reverse()
    out, free = [], 0
    for k, m in enumerate(tags):
        end = None if m[1] or m.start() < free else ends[k].get(m[2].lower())
        if end:
            out.append(text[free : m.start()])
            free = end.end()
    return "".join([*out, text[free:]])


def balanced(text: str) -> list[str]:
    """Outermost {...} spans, braces in strings counted like others."""
    out, depth, start = [], 0, -1
    for m in re.finditer(r"[{}]", text):
        depth += 1 if m[0] == "{" else -1
        if m[0] == "{" and depth == 1:
            start = m.start()
        elif m[0] == "}" and depth == 0 and start >= 0:
            out.append(text[start : m.end()])
    return out


def fenced(text: str) -> list[str]:
    """What stands in braces between code fences; starts and ends are found by a scan each and then matched in order."""
    closes, out, free, k = [(m.start(), m.end()) for m in _CLOSES.finditer(text)], [], 0, 0
    for m in _OPENS.finditer(text):
        if m.start() < free:
            continue
        while k < len(closes) and closes[k][0] < m.end():
            k += 1
        if k == len(closes):
            break
        out.append(text[m.end() - 1 : closes[k][0] + 1])
        free = closes[k][1]
    return out


def candidates(text: str) -> list[str]:
    """Spans that may be JSON: fenced, balanced, then from the first to the last brace."""
    text = without_thinking(text)
    first, last = text.find("{"), text.rfind("}")
    return fenced(text) + balanced(text) + ([text[first : last + 1]] if 0 <= first < last else [])


def cleanup(text: str) -> str:
    return re.sub(r",(\s*[}\]])", r"\1", text.strip())


def escape_fix(text: str) -> str:
    """Backslashes before letters in strings are doubled, as in LaTeX commands."""
    return _STRING.sub(lambda m: '"' + re.sub(r"(?<!\\)\\(?=[A-Za-z])", r"\\\\", m[1]) + '"' if m[2] else m[0], text)


def quote_fix(text: str) -> str:
    """A lone backslash before the quote that ends a string is doubled, as in paths."""
    return re.sub(r'(?<!\\)\\(?="\s*(?:[,}\]:]|$))', r"\\\\", text)


def _load(text: str):
    """What JSON says; none if it is broken or nested beyond reason. NaN and the infinities are null."""
    try:
        return json.loads(text, parse_constant=lambda _: None)
    except (ValueError, RecursionError):
        return None


def fields(text: str) -> dict:
    """The known fields by pattern, with defaults."""

    def one(name: str, default: str) -> str:
        m = re.search(_FIELD.format(name), text, re.S)
        return m[1] if m else default

    description = one("detailed_description", "")
    return {"detailed_description": description, "entity_info": {"entity_name": one("entity_name", "unknown_entity"), "entity_type": one("entity_type", "unknown"), "summary": one("summary", description[:100])}}


def parse(text: str) -> dict:
    """The first candidate that parses to something, as it is, cleaned, or with escapes and last quotes mended; fields by pattern else."""
    spans = candidates(text)
    for mend in (lambda x: x, cleanup, escape_fix, lambda x: escape_fix(quote_fix(cleanup(x)))):
        for span in spans:
            if found := _load(mend(span)):
                return found
    return fields(text)


def entity(text: str, kind: str, name: str | None = None) -> dict:
    """description, entity_name, entity_type, summary of a model's answer about an item of some kind."""
    found = parse(text)
    info = found.get("entity_info") if isinstance(found, dict) else None
    description = found.get("detailed_description") if isinstance(found, dict) else None
    if description and isinstance(info, dict) and {"entity_name", "entity_type", "summary"} <= info.keys():
        return {"description": str(description), "entity_name": name or f"{info['entity_name']} ({info['entity_type']})", "entity_type": str(info["entity_type"]), "summary": str(info["summary"])}
    import hashlib

    plain = without_thinking(text).strip()
    return {"description": plain, "entity_name": name or f"{kind}_{hashlib.md5(plain.encode()).hexdigest()}", "entity_type": kind, "summary": plain[:100] + "..." * (len(plain) > 100)}


ENTITY = "struct<description:string,entity_name:string,entity_type:string,summary:string>"
_ENTITY = pa.struct([(k, pa.string()) for k in ("description", "entity_name", "entity_type", "summary")])


def entities(answer: Column, kind: Column, name: Column | None = None) -> Column:
    """entity() of each row, as a struct; null for a null answer."""

    @F.arrow_udf(ENTITY)
    def run(answers: pa.Array, kinds: pa.Array, names: pa.Array) -> pa.Array:
        return pa.array([None if a is None else entity(a, k or "generic", n) for a, k, n in zip(answers.to_pylist(), kinds.to_pylist(), names.to_pylist(), strict=True)], _ENTITY)

    return run(answer, kind, F.lit(None).cast("string") if name is None else name)


def parsed(answer: Column) -> Column:
    """parse() of each row, as canonical JSON."""

    @F.arrow_udf("string")
    def run(answers: pa.Array) -> pa.Array:
        return pa.array([None if a is None else json.dumps(parse(a), sort_keys=True, ensure_ascii=False) for a in answers.to_pylist()], pa.string())

    return run(answer)


#: What a judge may score: accuracy as 0 or 1, the others from 0 to 1.
SCORES = ("accuracy", "relevance", "completeness", "faithfulness", "clarity", "consistency", "overall_score")
_SCORE = re.compile(r"\b(" + "|".join(SCORES) + r")\b[\"']?\s*(?:[:=]|is\b)\s*[\"']?(true\b|false\b|-?[0-9]+(?:\.[0-9]+)?(?![0-9.]*[0-9eE]))", re.I)
_WHY = re.compile(r'"reasoning"\s*:\s*"((?:[^"\\]|\\.)*)', re.S)
#: Words of a verdict given in prose: 1 speaks for the answer, -1 against it.
VERDICT = dict.fromkeys("correct correctly accurate accurately right true yes match matches agree agrees equivalent".split(), 1) | dict.fromkeys("incorrect incorrectly inaccurate wrong false mismatch mismatches disagrees contradicts contradiction contradictory differs".split(), -1)
_NEGATES = {"not", "no", "never", "neither", "nor", "without", "hardly", "cannot", "isnt", "doesnt", "wasnt", "arent", "dont", "cant"}
REACH = 3  # words back within a sentence over which a negation holds


def verdict(text: str) -> int:
    """1 if some word speaks for the answer and none against it, with negations turned round; else 0."""
    votes = []
    for sentence in re.split(r"[.!?;\n]+", text.lower()):
        words = re.findall(r"[a-z]+(?:['\u2019][a-z]+)?", sentence)
        words = [re.sub(r"['\u2019]", "", w) for w in words]
        for k, w in enumerate(words):
            if w in VERDICT:
                turned = sum(x in _NEGATES for x in words[max(0, k - REACH) : k]) % 2
                votes.append(-VERDICT[w] if turned else VERDICT[w])
        if words == ["no"]:
            votes.append(-1)
    return int(bool(votes) and min(votes) > 0)


def scores(text: str) -> dict:
    """A judge's scores and reasoning. One scan for "name: number" reads JSON, whether fenced, cut short, doubled or with
    stray characters, and prose alike: of each name the first number in range counts. Without an accuracy the words decide."""
    out: dict = dict.fromkeys(SCORES)
    text = without_thinking(text)
    for m in _SCORE.finditer(text):
        name, said = m[1].lower(), m[2].lower()
        value = {"true": 1.0, "false": 0.0}.get(said)
        value = float(said) if value is None else value
        if out[name] is None and (value in (0.0, 1.0) if name == "accuracy" else 0 <= value <= 1):
            out[name] = int(value) if name == "accuracy" else value
    if out["accuracy"] is None:
        out["accuracy"] = verdict(_SCORE.sub(" ", text))
    why = _WHY.search(text)
    out["reasoning"] = _unescaped(why[1]) if why else None
    return out


def _unescaped(said: str) -> str:
    found = _load('"' + re.sub(r"[\x00-\x1f]", " ", said) + '"')
    return said if found is None else found


_JUDGED = pa.struct([("accuracy", pa.int32()), *((k, pa.float64()) for k in SCORES[1:]), ("reasoning", pa.string())])


def judged(answer: Column) -> Column:
    """scores() of each row as a struct; a null answer has no scores, and accuracy 0."""

    @F.arrow_udf("struct<accuracy:int," + "".join(f"{k}:double," for k in SCORES[1:]) + "reasoning:string>")
    def run(answers: pa.Array) -> pa.Array:
        return pa.array([scores(a or "") for a in answers.to_pylist()], _JUDGED)

    return run(answer)
