"""Metadata that a document brings along: the third source of T3, after the request and its metadata file.

Markdown: a head block, ``---`` on the first line up to the next line ``---`` or ``...``, with lines ``key: value``. A value
``[a, b]`` is a list, and so are the lines ``- item`` after a key without a value; quotes around a value are dropped. Other
lines are ignored; without a line of a key the block is ordinary text. HTML: the title, and the ``meta`` tags with a name
and a content, before the body. Definitions are ours. A key's first mention counts, repeated ``meta`` names add up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.codecs import collapse_blanks, html_unescape, let

ENTRIES = "array<struct<key:string,value:array<string>>>"
HEAD_RE = r"(?s)^---[ \t]*\r?\n(.*?\n)??(?:---|\.\.\.)[ \t]*(?:\r?\n|$)"
KEY_RE = r"^([A-Za-z0-9_.-]+):(?:[ \t]+(.*?))?[ \t]*$"
ITEM_RE = r"^[ \t]*-[ \t]+(.*?)[ \t]*$"
META_RE = r"(?is)<meta\b[^>]*>"


def _entry(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


def _unquoted(v: Column) -> Column:
    return F.when(v.rlike("""^(".*"|'.*')$"""), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)


def _head_lines(text: Column) -> Column:
    return F.split(F.regexp_replace(F.regexp_extract(text, HEAD_RE, 1), "\r", ""), "\n", -1)


def has_head(text: Column) -> Column:
    """Whether a Markdown text starts with a metadata block."""
    return F.startswith(text, F.lit("---")) & F.exists(_head_lines(text), lambda x: x.rlike(KEY_RE))


def without_head(text: Column) -> Column:
    return F.when(has_head(text), F.regexp_replace(text, HEAD_RE, "")).otherwise(text)


def markdown_metadata(text: Column) -> Column:
    """Array of (key, value array) of the head block, in order."""
    def read(lines):
        def entry(at, k, starts):
            line = F.get(lines, at)
            value = F.regexp_extract(line, KEY_RE, 2)
            below = F.slice(lines, at + 2, F.coalesce(F.get(starts, k + 1), F.size(lines)) - at - 1)
            items = F.transform(F.filter(below, lambda x: x.rlike(ITEM_RE)), lambda x: _unquoted(F.regexp_extract(x, ITEM_RE, 1)))
            listed = F.transform(F.split(F.substring(value, F.lit(2), F.length(value) - 2), ",", -1), lambda x: _unquoted(F.trim(x)))
            return _entry(F.regexp_extract(line, KEY_RE, 1), F.when(value == "", items).when(value.rlike(r"^\[.*\]$"), listed)
                          .otherwise(F.array(_unquoted(value))))

        keys = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(KEY_RE), i)), lambda i: i.isNotNull())
        return let(keys, lambda starts: F.transform(starts, lambda at, k: entry(at, k, starts)))

    return F.when(has_head(text), let(_head_lines(text), read)).otherwise(F.array().cast(ENTRIES))


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value, unescaped; empty when missing."""
    found = [F.regexp_extract(tag, r"""(?is)\s""" + name + r"""\s*=\s*""" + f"{q}([^{q}]*){q}", 1) for q in "\"'"]
    return html_unescape(F.concat(*found))


def html_metadata(html: Column) -> Column:
    """The title and the named ``meta`` tags (names in lower case) before the body."""
    def read(head):
        title = collapse_blanks(html_unescape(F.regexp_extract(head, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)))
        tags = F.filter(F.transform(F.regexp_extract_all(head, F.lit(META_RE), 0), lambda t: F.struct(
            F.lower(_attribute(t, "name")).alias("k"), _attribute(t, "content").alias("v"))), lambda e: (e["k"] != "") & (e["v"] != ""))
        metas = let(tags, lambda ts: F.transform(F.array_distinct(F.transform(ts, lambda e: e["k"])), lambda k: _entry(
            k, F.transform(F.filter(ts, lambda e: e["k"] == k), lambda e: e["v"]))))
        return F.concat(F.when(title != "", F.array(_entry(F.lit("title"), F.array(title)))).otherwise(F.array().cast(ENTRIES)), metas)

    return let(F.get(F.split(F.regexp_replace(html, "(?s)<!--.*?-->", ""), r"(?i)<body\b", 2), F.lit(0)), read)


def document_metadata(text: Column, frm: Column) -> Column:
    """Array of (key, value array) that a document brings along, by its input format; plain text has none."""
    return F.when(frm == "markdown", markdown_metadata(text)).when(frm == "html", html_metadata(text)).otherwise(F.array().cast(ENTRIES))
