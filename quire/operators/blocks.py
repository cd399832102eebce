"""Documents -> ordered blocks (B1 html, B2 plain / markdown, B4 strip empty paragraphs).

Two forms of the same data:

* in-row: ``array<struct<block_no:int, kind:string, level:int, text:string>>`` next to ``doc_id``. Conversions that
  stay inside one document use it and need no shuffle at all.
* table: ``blocks(doc_id, block_no, kind, level, text)``, one row per block (``explode_blocks``). Operators that
  count, join or window over blocks use it; ``quire.operators.render.assemble`` puts it back in order.

``kind`` is ``heading`` (level 1-6), ``item`` or ``para`` (level 0). ``block_no`` starts at 1 (0 for HTML text before the
first block tag) and keeps its gaps when blocks are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.codecs import html_unescape
from quire.sources.requests import compute_once

BLOCK_TYPE = "array<struct<block_no:int,kind:string,level:int,text:string>>"

# Fixed values of the HTML block splitter.
HTML_BLOCK_TAGS = ("h[1-6]|p|li|div|footer|nav|article|ul|td|tr|section|header|main|aside|blockquote|pre|table|th|"
                   "ol|dl|dt|dd|hr|figure|figcaption|address|form|fieldset")
HTML_STRIP_RE = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<!--.*?-->"
HTML_MARK_RE = r"(?i)<(" + HTML_BLOCK_TAGS + r")\b[^>]*>"
TAG_RE = r"<[^>]*>"
MARK, ENDTAG = "\u0001", "\u0002"

MD_HEADING_RE = r"^(#{1,6}) "
MD_ITEM_RE = r"^[-*+] "


def unmarked(text: Column) -> Column:
    """U+0001 and U+0002 mark block starts while a document is split; where a document holds them itself, or HTML references
    to them, they become U+FFFD, so that no text can pass for a mark."""
    return F.replace(F.replace(text, F.lit(MARK), F.lit("\ufffd")), F.lit(ENDTAG), F.lit("\ufffd"))


def _unreferenced(html: Column) -> Column:
    return F.when(F.instr(html, "&#") > 0, F.regexp_replace(html, "&#(?:0*[12]|[xX]0*[12]);", "\ufffd")).otherwise(html)


def _block(no: Column, kind: Column, level: Column, text: Column) -> Column:
    return F.struct(
        no.cast("int").alias("block_no"), kind.alias("kind"), level.cast("int").alias("level"), text.alias("text")
    )


def html_block_array(html: Column) -> Column:
    """B1. Remove script/style/head/comments, start a block at each opening block tag, drop other tags, decode
    character references, collapse blanks. Text before the first block tag is a para, block 0."""
    s = F.regexp_replace(_unreferenced(unmarked(html)), HTML_STRIP_RE, "")
    s = F.regexp_replace(s, HTML_MARK_RE, MARK + "$1" + ENDTAG)
    s = F.regexp_replace(s, TAG_RE, " ")
    s = F.regexp_replace(html_unescape(s), r"[ \t\r\n]+", " ")
    def one(x, i):
        tag = F.when(i > 0, F.lower(F.substring_index(x, ENDTAG, 1))).otherwise(F.lit(""))
        text = F.trim(F.substring(x, F.instr(x, ENDTAG) + 1, 1 << 30))
        is_h = tag.rlike("^h[1-6]$")
        kind = F.when(is_h, "heading").when(tag == "li", "item").otherwise("para")
        level = F.when(is_h, F.substring(tag, 2, 1).cast("int")).otherwise(0)
        return _block(i, kind, level, text)

    return F.filter(F.transform(F.split(s, MARK, -1), one), lambda b: (b["block_no"] > 0) | (b["text"] != ""))


def plain_block_array(text: Column) -> Column:
    """B2, from=plain: one para block per line."""
    return F.transform(F.split(text, "\n", -1), lambda x, i: _block(i + 1, F.lit("para"), F.lit(0), x))


def markdown_block_array(text: Column) -> Column:
    """B2, from=markdown: a line ``#{1,6} text`` is a heading, a line ``[-*+] text`` an item, other lines form
    paragraphs separated by blank lines (inner newlines kept)."""
    s = F.regexp_replace(unmarked(text), r"\r\n", "\n")
    s = F.regexp_replace(s, r"(?m)^((#{1,6}|[-*+]) [^\n]*)$", MARK + "$1" + MARK)
    s = F.regexp_replace(s, r"\n([ \t]*\n)+", MARK)
    pieces = F.filter(F.split(s, "\n?" + MARK + "+\n?", -1), lambda x: F.trim(x) != "")

    def one(x, i):
        head = F.regexp_extract(x, MD_HEADING_RE, 1)
        is_h, is_i = F.length(head) > 0, x.rlike(MD_ITEM_RE)
        kind = F.when(is_h, "heading").when(is_i, "item").otherwise("para")
        level = F.when(is_h, F.length(head)).otherwise(0)
        body = F.when(is_h, F.substring(x, F.length(head) + 2, 1 << 30)).when(is_i, F.substring(x, 3, 1 << 30))
        return _block(i + 1, kind, level, F.trim(F.coalesce(body, x)))

    return F.transform(pieces, one)


def block_array(content: Column, fmt: str) -> Column:
    if fmt == "html":
        return html_block_array(content)
    if fmt == "markdown":
        return markdown_block_array(content)
    if fmt == "plain":
        return plain_block_array(content)
    raise ValueError(f"unknown input format {fmt!r}")


def drop_empty_paras(blocks: Column) -> Column:
    """B4 in-row: drop para blocks whose trimmed text is empty; numbers keep their gaps."""
    return F.filter(blocks, lambda b: ~((b["kind"] == "para") & (F.trim(b["text"]) == "")))


def explode_blocks(df: DataFrame, col: str = "blocks", key: str = "doc_id") -> DataFrame:
    """In-row blocks -> block table (narrow: keeps the partitioning of ``df``).

    The array is materialised first (``compute_once``): Catalyst infers a ``size(array) > 0`` filter for the explode
    and pushes it down, which would otherwise parse every document twice."""
    return compute_once(df.select(key, F.col(col).alias("b__")), bl__=F.col("b__")).select(key, F.inline("bl__"))


def html_blocks(docs: DataFrame, content: str = "content") -> DataFrame:
    """B1 as a table."""
    return explode_blocks(docs.select("doc_id", html_block_array(F.col(content)).alias("blocks")))


def text_blocks(docs: DataFrame, fmt: str, content: str = "content") -> DataFrame:
    """B2 as a table."""
    return explode_blocks(docs.select("doc_id", block_array(F.col(content), fmt).alias("blocks")))


def strip_empty_paragraphs(blocks: DataFrame) -> DataFrame:
    """B4 on the block table."""
    return blocks.filter(~((F.col("kind") == "para") & (F.trim("text") == "")))


__all__ = [
    "BLOCK_TYPE", "html_block_array", "plain_block_array", "markdown_block_array", "block_array",
    "drop_empty_paras", "explode_blocks", "html_blocks", "text_blocks", "strip_empty_paragraphs",
]
