"""Blocks -> document text (B5 plain, B6 markdown, B7 html) and the ordered regroup of a block table.

Renderers are Column expressions over the in-row block array, so a conversion that never leaves the document row
has no shuffle. ``assemble`` turns a block table back into that array: one hash shuffle on ``doc_id`` (partial
aggregation is not possible for an ordered list, but a document is one bounded group) and a sort inside the group,
never trusting input order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.codecs import html_escape, let


def assemble(blocks: DataFrame, key: str = "doc_id", out: str = "blocks") -> DataFrame:
    """Block table -> (key, blocks array sorted by block_no)."""
    s = F.struct("block_no", "kind", "level", "text")
    return blocks.groupBy(key).agg(F.array_sort(F.collect_list(s)).alias(out))


def _non_empty(blocks: Column) -> Column:
    return F.filter(blocks, lambda b: b["text"] != "")


def render_plain(blocks: Column) -> Column:
    """Non-empty block texts in order, joined by a blank line; items get ``- ``."""
    parts = F.transform(
        _non_empty(blocks),
        lambda b: F.when(b["kind"] == "item", F.concat(F.lit("- "), b["text"])).otherwise(b["text"]),
    )
    return F.array_join(parts, "\n\n")


def markdown_piece(b, atx: bool = True) -> Column:
    """One block in markdown: atx headings ``#``*level; without atx, levels 1-2 are underlined with ``=``/``-`` of the
    same length; items get ``- ``."""
    atx_head = F.concat(F.repeat(F.lit("#"), b["level"]), F.lit(" "), b["text"])
    if atx:
        head = atx_head
    else:
        line = F.repeat(F.when(b["level"] == 1, F.lit("=")).otherwise(F.lit("-")), F.length(b["text"]))
        head = F.when(b["level"] <= 2, F.concat(b["text"], F.lit("\n"), line)).otherwise(atx_head)
    return (
        F.when(b["kind"] == "heading", head)
        .when(b["kind"] == "item", F.concat(F.lit("- "), b["text"]))
        .otherwise(b["text"])
    )


def render_markdown(blocks: Column, atx: bool = True) -> Column:
    """The non-empty blocks in markdown, separated by a blank line."""
    return F.array_join(F.transform(_non_empty(blocks), lambda b: markdown_piece(b, atx)), "\n\n")


def html_body(b) -> Column:
    """One block as (kind, html), lists not yet opened and closed."""
    text, lvl = html_escape(b["text"]), b["level"].cast("string")
    return F.struct(b["kind"].alias("kind"), (
        F.when(b["kind"] == "heading", F.concat(F.lit("<h"), lvl, F.lit(">"), text, F.lit("</h"), lvl, F.lit(">")))
        .when(b["kind"] == "item", F.concat(F.lit("<li>"), text, F.lit("</li>")))
        .otherwise(F.concat(F.lit("<p>"), text, F.lit("</p>")))).alias("html"))


def join_html(bodies: Column) -> Column:
    """(kind, html) in order -> the document; each run of consecutive items is wrapped in one ``<ul>``."""
    def whole(bd):
        def one(b, i):
            is_item = b["kind"] == "item"
            opens = is_item & ~F.coalesce(F.when(i > 0, F.get(bd, i - 1)["kind"] == "item"), F.lit(False))
            ends = is_item & ~F.coalesce(F.get(bd, i + 1)["kind"] == "item", F.lit(False))
            return F.concat(F.when(opens, F.lit("<ul>\n")).otherwise(F.lit("")), b["html"],
                            F.when(ends, F.lit("\n</ul>")).otherwise(F.lit("")))

        return F.array_join(F.transform(bd, one), "\n")

    return let(bodies, whole)


def render_html(blocks: Column) -> Column:
    """``<hN>`` / ``<p>`` with escaped text; each run of consecutive items is wrapped in one ``<ul>``."""
    return join_html(F.transform(_non_empty(blocks), html_body))


def render(blocks: Column, to: str, atx: bool = True) -> Column:
    t = to.lower()
    if t in ("plain", "txt", "text"):
        return render_plain(blocks)
    if t in ("markdown", "md"):
        return render_markdown(blocks, atx)
    if t in ("html", "html5"):
        return render_html(blocks)
    raise ValueError(f"unknown output format {to!r}")
