"""Scalar text functions as columns; all stay inside generated code or the JVM's expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space at either end. A run within is tried from its first character only, so the scan is linear."""
    return F.regexp_replace(_c(x), r"^\s+|(?<!\s)\s+$", "")


def blank(x: Column | str) -> Column:
    return F.coalesce(strip(x), F.lit("")) == ""


def hash_id(x: Column | str, prefix: str = "") -> Column:
    """prefix + md5 hex."""
    return F.concat(F.lit(prefix), F.md5(_c(x)))


def last_index(x: Column | str, char: str) -> Column:
    """0-based place of the last char, -1 without one."""
    at = F.instr(F.reverse(_c(x)), char)
    return F.when(at == 0, F.lit(-1)).otherwise(F.length(_c(x)) - at)


def truncate(x: Column | str, limit: int) -> Column:
    """x up to limit characters, cut after the last full stop or before the last line end if that keeps over 80 %, else with dots."""
    cut = F.left(_c(x), F.lit(limit))
    stop, line, most = last_index(cut, "."), last_index(cut, "\n"), F.length(cut) * 0.8
    short = F.when(stop > most, F.left(cut, stop + 1)).when(line > most, F.left(cut, line)).otherwise(F.concat(cut, F.lit("...")))
    return F.when(F.length(_c(x)) <= limit, _c(x)).otherwise(short)


def strip_thinking(x: Column | str) -> Column:
    """Without the blocks in which models think aloud; a block without an end stays.

    Marks are looked for only up to the last end mark, so each start mark there finds its end and the scan is linear."""
    out = _c(x)
    for tag in ("think", "thinking"):
        end = f"</{tag}>"
        lower = F.translate(out, "".join(sorted({c.upper() for c in tag})), "".join(sorted(set(tag))))
        at = F.instr(F.reverse(lower), end[::-1])
        head = F.length(out) - at + 1
        cut = F.concat(F.regexp_replace(F.left(out, head), f"(?is)<{tag}>.*?{end}", ""), F.substring(out, head + 1, F.length(out)))
        out = F.when(at == 0, out).otherwise(cut)
    return strip(out)


def json_cleanup(x: Column | str) -> Column:
    """Stripped, and without commas before closing brackets."""
    return F.regexp_replace(strip(x), r",(\s*[}\]])", "$1")


def _field(x: Column | str, name: str, group: int) -> Column:
    """What stands between the quotes behind a name (group 1), or all of that (0). A backslash takes the next character with
    it and nothing is given back, so an answer that was cut short costs one scan."""
    return F.regexp_extract(_c(x), rf'(?s)"{name}":\s*+"((?:[^"\\]++|\\.)*+)"', group)


def json_fields(x: Column | str) -> Column:
    """Struct of the four fields that can be found by pattern, with defaults."""

    def value(name: str, default: Column) -> Column:
        return F.when(_field(x, name, 0) == "", default).otherwise(_field(x, name, 1))

    description = value("detailed_description", F.lit(""))
    return F.struct(
        description.alias("description"),
        value("entity_name", F.lit("unknown_entity")).alias("entity_name"),
        value("entity_type", F.lit("unknown")).alias("entity_type"),
        value("summary", F.left(description, F.lit(100))).alias("summary"),
    )


def shorten(x: Column | str, n: int) -> Column:
    """At most n characters, dots where more was cut."""
    return F.when(F.length(_c(x)) > n, F.concat(F.left(_c(x), F.lit(n)), F.lit("..."))).otherwise(_c(x))


def basename(x: Column | str) -> Column:
    return F.element_at(F.split(_c(x), "/"), -1)


def extension(x: Column | str) -> Column:
    """With its dot, in lower case; empty without one."""
    return F.lower(F.regexp_extract(basename(x), r"(\.[^./]+)$", 1))


def relative_path(x: Column | str, root: str) -> Column:
    """Below root, with subfolders."""
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(_c(x), F.lit(base)), F.substring(_c(x), len(base) + 1, 1 << 30)).otherwise(basename(x))


def is_url(x: Column | str) -> Column:
    """A scheme and a host."""
    return F.regexp_like(_c(x), F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"))


def or_none(items: Column | str) -> Column:
    """Items joined by commas, "None" without any."""
    return F.coalesce(F.nullif(F.array_join(_c(items), ", "), F.lit("")), F.lit("None"))


def tokens(x: Column | str) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(_c(x), r"\s+"), lambda w: w != ""))


def paragraphs(x: Column | str) -> Column:
    """Non-blank paragraphs, stripped; the whole text if there is none."""
    parts = F.filter(F.transform(F.split(_c(x), "\n\n"), strip), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(_c(x)))


def heading_level(line: Column | str) -> Column:
    return F.length(F.regexp_extract(_c(line), "^(#+)", 1))


def inline_markup(x: Column | str) -> Column:
    """Markdown's inline marks as HTML. Code between back quotes comes first and is left as it is; other marks hold within
    a line and between two spans of code; a back quote without a partner is itself."""
    parts = F.split(F.replace(F.replace(F.replace(_c(x), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), "`")

    def styled(v: Column) -> Column:
        for mark, to in STYLES:
            v = F.regexp_replace(v, mark, to)
        return v

    last = F.size(parts) - 1
    code = lambda i: (i % 2 == 1) & (i < last)
    shown = F.transform(parts, lambda v, i: F.when(code(i), F.concat(F.lit("<code>"), v, F.lit("</code>"))).when(i % 2 == 1, F.concat(F.lit("`"), styled(v))).otherwise(styled(v)))
    return F.array_join(shown, "")


#: What stands for what, applied in this order to text that isn't code.
STYLES = (
    (r"\[([^\[\]\n]+)\]\(([^()\s\"]+)\)", '<a href="$2">$1</a>'),
    (r"\*\*([^*\n]+)\*\*", "<strong>$1</strong>"),
    (r"(^|[\s(])__([^_\n]+)__", "$1<strong>$2</strong>"),
    (r"~~([^~\n]+)~~", "<del>$1</del>"),
    (r"(^|[\s(])\*([^*\s][^*\n]*)\*", "$1<em>$2</em>"),
    (r"(^|[\s(])_([^_\s][^_\n]*)_", "$1<em>$2</em>"),
)


def image_data(content: Column | str) -> Column:
    """An image's bytes as base64, empty without any."""
    return F.coalesce(F.base64(_c(content)), F.lit(""))


def page_of(pos: Column | str, per_page: int = 10) -> Column:
    return F.floor(_c(pos) / per_page).cast("int")


def page(body: Column | str, title: str = "Document", style: str = "body{font-family:serif;margin:2em}") -> Column:
    """A whole HTML document around a body."""
    return F.concat(F.lit(f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title><style>{style}</style></head><body>'), _c(body), F.lit("</body></html>"))


def markdown_page(x: Column | str) -> Column:
    """Markdown's lines as an HTML document: headings, list items, paragraphs, with their inline markup."""

    def line(v: Column) -> Column:
        level = F.least(heading_level(v), F.lit(6)).cast("string")
        rest = inline_markup(strip(F.regexp_replace(v, r"^(#+|[-*+] )", "")))
        return F.when(heading_level(v) > 0, F.concat(F.lit("<h"), level, F.lit(">"), rest, F.lit("</h"), level, F.lit(">"))).when(v.rlike("^[-*+] "), F.concat(F.lit("<li>"), rest, F.lit("</li>"))).otherwise(F.concat(F.lit("<p>"), rest, F.lit("</p>")))

    lines = F.filter(F.split(_c(x), "\n"), lambda v: strip(v) != "")
    return page(F.array_join(F.transform(lines, line), ""))
