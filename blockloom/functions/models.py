"""Models as functions over Arrow batches: called once for a batch, loaded once in a worker, failing row by row.

A text or vision model is a function from a list of prompts to a list of answers; an embedding model gives a list of
vectors. Tests use the deterministic stubs below."""

from __future__ import annotations

import hashlib
import json
import random
import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TextModel = Callable[[list[str]], list[str]]
VectorModel = Callable[[list[str]], list[list[float]]]
#: Requests hold system (text), parts (type "text" or "image", text, image: a number) and images (base64 or paths).
VisionModel = Callable[[list[dict]], list[str]]
PairModel = Callable[[list[tuple[str, str]]], list[float]]
Encoder = Callable[[list[str]], list[list[int]]]
#: For each text where its tokens start and end, in code points and in order.
OffsetEncoder = Callable[[list[str]], list[list[tuple[int, int]]]]


class Rejected(Exception):
    """A call that an open breaker didn't let through."""


def retry(call: Callable, attempts: int = 3, base: float = 1.0, most: float = 60.0, factor: float = 2.0, jitter: bool = True, on: tuple = (Exception,), sleep: Callable = time.sleep, told: Callable | None = None) -> Callable:
    """call, again after growing waits while it raises one of on, attempts times in all."""
    if attempts < 1:
        raise ValueError("a call needs an attempt")

    def run(*a, **k):
        for n in range(1, attempts + 1):
            try:
                return call(*a, **k)
            except on as e:
                if n == attempts:
                    raise
                wait = min(base * factor ** (n - 1), most) * (1 + random.uniform(0, 0.5) * jitter)
                if told:
                    told(n, e, wait)
                sleep(wait)

    return run


def guarded(call: Callable, breaker, clock: Callable = time.monotonic) -> Callable:
    """call, rejected while a breaker (streaming.streams.Breaker) is open; each worker has its own."""

    def run(*a, **k):
        now = clock()
        if breaker.state == "open" and now - breaker.last < breaker.reset:
            breaker.rejected += 1
            raise Rejected("the breaker is open")
        try:
            out = call(*a, **k)
        except Exception:
            breaker.call(now, False)
            raise
        breaker.call(now, True)
        return out

    return run


#: Characters of texts whose windows Python holds at once, unless one text has more.
PIECE = 1 << 18

_ANSWER = pa.struct([("value", pa.string()), ("error", pa.string())])


def _called(model: Callable, requests: list) -> list[dict]:
    """value and error of each request that isn't null. If a batch fails, its rows are tried one by one."""
    at = [k for k, r in enumerate(requests) if r is not None]
    out: list = [{"value": None, "error": None} for _ in requests]
    try:
        for k, v in zip(at, model([requests[k] for k in at]) if at else [], strict=True):
            out[k]["value"] = v
    except Exception:
        for k in at:
            try:
                out[k]["value"] = model([requests[k]])[0]
            except Exception as e:
                out[k]["error"] = f"{type(e).__name__}: {e}"
    return out


def answers(prompt: Column, load: Callable[[], TextModel]) -> Column:
    """struct<value, error> of each prompt; null prompts have neither. If a batch fails, its rows are tried one by one."""
    held: list = []

    @F.arrow_udf("struct<value:string,error:string>")
    def run(prompts: pa.Array) -> pa.Array:
        if not held:
            held.append(load())
        return pa.array(_called(held[0], prompts.to_pylist()), _ANSWER)

    return run(prompt)


def seen(system: Column, parts: Column, images: Column, load: Callable[[], VisionModel]) -> Column:
    """struct<value, error> of what a vision model says to each message; null parts have neither."""
    held: list = []

    @F.arrow_udf("struct<value:string,error:string>")
    def run(systems: pa.Array, lists: pa.Array, pictures: pa.Array) -> pa.Array:
        if not held:
            held.append(load())
        rows = zip(systems.to_pylist(), lists.to_pylist(), pictures.to_pylist(), strict=True)
        return pa.array(_called(held[0], [None if p is None else {"system": s, "parts": p, "images": i or []} for s, p, i in rows]), _ANSWER)

    return run(system, parts, images)


def pair_scores(left: Column, right: Column, load: Callable[[], PairModel]) -> Column:
    """A model's score of each pair; null for a pair with a null, and for one that the model fails on alone."""
    held: list = []

    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        if not held:
            held.append(load())
        rows = list(zip(a.to_pylist(), b.to_pylist(), strict=True))
        got = _called(held[0], [None if None in r else r for r in rows])
        return pa.array([None if g["value"] is None else float(g["value"]) for g in got], pa.float64())

    return run(left, right)


def stub_overlap() -> PairModel:
    """The share of a question's words that its text has, for tests."""

    def one(question: str, text: str) -> float:
        q, t = ({w for w in re.split(r"[ \t\r\n]+", x) if w} for x in (question, text))
        return round(len(q & t) / max(1, len(q)), 6)

    return lambda pairs: [one(q, t) for q, t in pairs]


def token_counts(text: Column, load: Callable[[], Encoder]) -> Column:
    """How many tokens an encoder gives; null for null."""
    held: list = []

    @F.arrow_udf("int")
    def run(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(load())
        rows = texts.to_pylist()
        at = [k for k, t in enumerate(rows) if t is not None]
        out: list = [None] * len(rows)
        for k, ids in zip(at, held[0]([rows[k] for k in at]) if at else [], strict=True):
            out[k] = len(ids)
        return pa.array(out, pa.int32())

    return run(text)


def tokenizer_offsets(path: str) -> Callable[[], OffsetEncoder]:
    """Offsets by a tokenizer's file as the tokenizers library reads it."""

    def load() -> OffsetEncoder:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda texts: [e.offsets for e in t.encode_batch(texts, add_special_tokens=False)]

    return load


def windows_of(offsets: list[tuple[int, int]], length: int, size: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(start, end, tokens, fresh) of windows of size tokens, each sharing overlap with the one before. A window ends where the
    next token starts, so what stands between tokens stays; what is fresh of a window begins where the one before ended."""
    if size <= overlap or overlap < 0:
        raise ValueError("a window must be larger than its overlap")
    out, n, first = [], len(offsets), 0
    while True:
        last = first + size >= n
        start, end = offsets[first][0] if first else 0, length if last else offsets[first + size][0]
        out.append((start, end, min(n, first + size) - first, (out[-1][1] if out else 0) - start))
        if last:
            return out
        first += size - overlap


def token_windows(text: Column, size: int, overlap: int, load: Callable[[], OffsetEncoder]) -> Column:
    """array<struct<start, tokens, fresh, content>> of a text, by one encoding of it; null for null, one empty window for an
    empty text. Contents from fresh on, joined, are the text. Windows leave Python after each PIECE of text, so a batch's are never held together."""
    held: list = []
    item = pa.list_(pa.struct([("start", pa.int32()), ("tokens", pa.int32()), ("fresh", pa.int32()), ("content", pa.string())]))

    @F.arrow_udf("array<struct<start:int,tokens:int,fresh:int,content:string>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not held:
            held.append(load())
        for texts in batches:
            out: list = []
            held_now = 0
            for x in texts:
                t = x.as_py()
                out.append(None if t is None else [{"start": a, "tokens": n, "fresh": f, "content": t[a:b]} for a, b, n, f in windows_of(held[0]([t])[0], len(t), size, overlap)])
                held_now += len(t or "")
                if held_now >= PIECE:
                    yield pa.array(out, item)
                    out, held_now = [], 0
            yield pa.array(out, item)

    return run(text)


def within_tokens(text: Column, limit: int, load: Callable[[], OffsetEncoder]) -> Column:
    """The start of a text that has at most so many tokens, up to where the next one starts, with dots behind it if it was cut; by one encoding."""
    held: list = []

    def cut(t: str) -> str:
        offsets = held[0]([t])[0]
        return t if len(offsets) <= limit else t[: offsets[limit][0]] + "..."

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(load())
        return pa.array([None if t is None else cut(t) for t in texts.to_pylist()], pa.string())

    return run(text)


def stub_offsets() -> OffsetEncoder:
    """Where words stand, for tests."""
    return lambda texts: [[m.span() for m in re.finditer(r"[^ \t\r\n]+", t)] for t in texts]


def stub_encoder() -> Encoder:
    """Words' lengths, for tests."""
    return lambda texts: [[len(w) for w in t.split()] for t in texts]


def stub_vision() -> VisionModel:
    """Says how many texts and images a message has, and the md5 of its texts."""

    def one(request: dict) -> str:
        said = "\n".join(p["text"] for p in request["parts"] if p["type"] == "text")
        return f"{sum(p['type'] == 'image' for p in request['parts'])} of {len(request['images'])} images, {hashlib.md5(said.encode()).hexdigest()}"

    return lambda requests: [one(r) for r in requests]


def embeddings(text: Column, load: Callable[[], VectorModel], dim: int, normalise: bool = True) -> Column:
    """array<float> of dim components and norm 1; null for null. A model that gives another length is an error."""
    held: list = []

    @F.arrow_udf("array<float>")
    def run(texts: pa.Array) -> pa.Array:
        import numpy as np

        if not held:
            held.append(load())
        rows = texts.to_pylist()
        at = [k for k, t in enumerate(rows) if t is not None]
        out: list = [None] * len(rows)
        if at:
            m = np.asarray(held[0]([rows[k] for k in at]), np.float32)
            if m.shape != (len(at), dim):
                raise ValueError(f"the model gave vectors of shape {m.shape[1:]}, not {dim}")
            if normalise:
                n = np.linalg.norm(m, axis=1, keepdims=True)
                m = m / np.where(n > 0, n, 1)
            for k, v in zip(at, m.tolist(), strict=True):
                out[k] = v
        return pa.array(out, pa.list_(pa.float32()))

    return run(text)


def stub_text() -> TextModel:
    """Answers with JSON made from the prompt's md5."""

    def one(prompt: str) -> str:
        h = hashlib.md5(prompt.encode()).hexdigest()
        return "```json\n" + json.dumps({"detailed_description": f"about {h}", "entity_info": {"entity_name": h[:6], "entity_type": "thing", "summary": h[6:12]}}) + "\n```"

    return lambda prompts: [one(p) for p in prompts]


def stub_vectors(dim: int = 16) -> Callable[[], VectorModel]:
    """Bags of hashed words."""

    def load() -> VectorModel:
        def one(text: str) -> list[float]:
            out = [0.0] * dim
            for w in text.lower().split():
                out[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim] += 1.0
            return out

        return lambda texts: [one(t) for t in texts]

    return load
