"""Outline and layout operators on the in-row block array, for the conversion job.

The block-table forms in ``quire.operators.outline`` are the analytics versions (rows, windows); these are the same
definitions evaluated inside one document row, so a conversion with options still needs no shuffle. Spark evaluates the
body of a lambda once per element and does not hoist what it captures, so everything that belongs to the whole document
is bound once with ``let``, headings are put back among the other blocks by a sort on their place, and what belongs together
(equal slugs, the links of a scope) is a run of a sorted array, cut out by ``slice``. What is left beyond linear work are the
sorts and the bytes copied where the section counters append to a string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.codecs import html_escape, let
from quire.operators.normalize import wrap_columns
from quire.operators.outline import MAX_LEVEL, slug


def _block(b, text: Column | None = None, kind: Column | None = None, level: Column | None = None) -> Column:
    return F.struct(b["block_no"].alias("block_no"), (kind if kind is not None else b["kind"]).alias("kind"),
                    (level if level is not None else b["level"]).cast("int").alias("level"),
                    (text if text is not None else b["text"]).alias("text"))


def _is_heading(b) -> Column:
    return b["kind"] == "heading"


def map_headings(blocks: Column, values, apply, other=lambda b: b) -> Column:
    """Each heading ``h`` becomes ``apply(h, v)``, each other block ``other(b)``, in the old order. ``values``: the array of
    headings -> the array of their values, computed once. ``apply`` and ``other`` give structs of one type."""
    def placed(ix):
        return let(F.filter(ix, lambda x: _is_heading(x["b"])), lambda hs: let(
            values(F.transform(hs, lambda x: x["b"])), lambda vs: F.transform(F.sort_array(F.concat(
                F.transform(F.filter(ix, lambda x: ~_is_heading(x["b"])), lambda x: F.struct(
                    x["i"].alias("i"), other(x["b"]).alias("b"))),
                F.transform(hs, lambda x, j: F.struct(x["i"].alias("i"), apply(x["b"], F.get(vs, j)).alias("b"))))),
                lambda x: x["b"])))

    return let(F.transform(blocks, lambda b, i: F.struct(i.alias("i"), b.alias("b"))), placed)


def section_numbers(blocks: Column, offset: Column) -> Column:
    """Counter paths of the headings in order (the rule of ``outline.number_sections``)."""
    heads = F.filter(blocks, lambda b: b["kind"] == "heading")
    zero = F.array(*[F.lit(0)] * MAX_LEVEL)

    def bump(c, lvl):
        return F.transform(c, lambda v, k: F.when(k + 1 < lvl, v).when(k + 1 == lvl, v + 1).otherwise(F.lit(0)))

    def step(acc, h):
        c = bump(acc["c"], h["level"])
        shown = F.transform(F.slice(c, 1, h["level"]), lambda v, k: F.when(k == 0, v + offset).otherwise(v))
        num = F.array_join(F.transform(shown, lambda v: v.cast("string")), ".")
        return F.struct(c.alias("c"), F.concat(acc["out"], num, F.lit(",")).alias("out"))

    # one string, not an array: appending copies bytes and not an object per heading before
    init = F.struct(zero.alias("c"), F.lit("").alias("out"))
    return F.slice(F.split(F.aggregate(heads, init, step)["out"], ",", -1), 1, F.size(heads))


def number_headings(blocks: Column, offset: Column) -> Column:
    """number_sections: heading text becomes ``<number> <text>``."""
    return map_headings(blocks, lambda hs: section_numbers(hs, offset),
                        lambda h, num: _block(h, F.concat(num, F.lit(" "), h["text"])))


def heading_ids(blocks: Column, prefix: Column) -> Column:
    """ids of the headings in order (the rule of ``outline.header_ids``): repeats get ``-1``, ``-2``. Equal slugs are runs of
    the sorted slugs; a heading's place in its run is the number of its repeat. Two sorts, no growing array."""
    slugs = F.transform(F.filter(blocks, _is_heading), lambda b, j: F.struct(slug(b["text"]).alias("s"), j.alias("j")))

    def numbered(ss):
        opens = F.transform(ss, lambda x, i: F.when(~F.coalesce(F.get(ss, i - 1)["s"] == x["s"], F.lit(False)), i))
        return let(F.filter(opens, lambda i: i.isNotNull()), lambda starts: F.flatten(F.transform(starts, lambda at, k: F.transform(
            F.slice(ss, at + 1, F.coalesce(F.get(starts, k + 1), F.size(ss)) - at),
            lambda x, n: F.struct(x["j"].alias("j"), x["s"].alias("s"), n.alias("n"))))))

    return F.transform(F.sort_array(let(F.sort_array(slugs), numbered)), lambda x: F.concat(
        prefix, x["s"], F.when(x["n"] > 0, F.concat(F.lit("-"), x["n"].cast("string"))).otherwise(F.lit(""))))


def with_toc(blocks: Column, depth: Column) -> Column:
    """toc: the headings of level <= depth, as list items placed before the first block (block_no -1, no block's own)."""
    entries = F.filter(blocks, lambda b: (b["kind"] == "heading") & (b["level"] <= depth))
    items = F.transform(entries, lambda b: _block(b, F.concat(F.repeat(F.lit("  "), b["level"] - 1), b["text"]),
                                                  F.lit("item"), b["level"]))
    items = F.transform(items, lambda b: F.struct(F.lit(-1).alias("block_no"), b["kind"].alias("kind"),
                                                  b["level"].alias("level"), b["text"].alias("text")))
    return F.concat(items, blocks)


def with_references(blocks: Column, entries: Column) -> Column:
    """The list of cited entries, a numbered paragraph each, after the last block."""
    last = F.coalesce(F.try_element_at(blocks, F.lit(-1))["block_no"], F.lit(0))
    return F.concat(blocks, F.transform(entries, lambda e, i: F.struct(
        (last + i + 1).cast("int").alias("block_no"), F.lit("para").alias("kind"), F.lit(0).alias("level"),
        F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), e).alias("text"))))


def wrap_paragraphs(blocks: Column, mode: Column, columns: Column) -> Column:
    """wrap auto / none applied to paragraph texts (headings and items stay on one line)."""
    return F.transform(blocks, lambda b: F.when(b["kind"] == "para", _block(
        b, F.when(mode == "auto", wrap_columns(b["text"], columns))
        .when(mode == "none", F.regexp_replace(b["text"], "\n", " ")).otherwise(b["text"]))).otherwise(b))


def section_closes(levels: Column) -> Column:
    """For each heading (levels in order): how many open sections it closes (those of its level or deeper), and as
    the last element the sections still open at the end. The open levels form a strictly increasing stack of at most
    six entries, kept by one ``aggregate``."""
    init = F.struct(F.array().cast("array<int>").alias("stack"), F.lit("").alias("closes"))

    def step(acc, lvl):
        popped = F.size(F.filter(acc["stack"], lambda v: v >= lvl))
        return F.struct(F.concat(F.filter(acc["stack"], lambda v: v < lvl), F.array(lvl)).alias("stack"),
                        F.concat(acc["closes"], popped.cast("string")).alias("closes"))  # a digit each

    done = F.aggregate(levels, init, step, lambda acc: F.concat(acc["closes"], F.size(acc["stack"]).cast("string")))
    return F.transform(F.filter(F.split(done, ""), lambda d: d != ""), lambda d: d.cast("int"))


def render_html_ids(blocks: Column, prefix: Column, sections: Column | None = None) -> Column:
    """B7 with ``id`` attributes on headings when ``prefix`` is set (id_prefix) and, when ``sections`` holds
    (section_divs), each heading opening a ``<section>`` that ends before the next heading of the same or a higher
    level."""
    from quire.operators.render import html_body, join_html

    sections = F.lit(False) if sections is None else sections

    def values(hs):
        """(id, sections closed before) of each heading."""
        ids = F.when(prefix != "", heading_ids(hs, prefix)).otherwise(F.transform(hs, lambda h: F.lit("")))
        closes = F.when(sections, section_closes(F.transform(hs, lambda h: h["level"]))).otherwise(
            F.transform(hs, lambda h: F.lit(0)))
        return F.transform(F.arrays_zip(ids.alias("id"), F.slice(closes, 1, F.size(hs)).alias("closes")), lambda x: x)

    def head(h, v):
        lvl = h["level"].cast("string")
        id_attr = F.when(prefix != "", F.concat(F.lit(' id="'), html_escape(v["id"]), F.lit('"'))).otherwise(F.lit(""))
        open_ = F.when(sections, F.concat(F.repeat(F.lit("</section>\n"), v["closes"]), F.lit("<section>\n"))) \
            .otherwise(F.lit(""))
        return F.struct(h["kind"].alias("kind"), F.concat(
            open_, F.lit("<h"), lvl, id_attr, F.lit(">"), html_escape(h["text"]), F.lit("</h"), lvl, F.lit(">")).alias("html"))

    def body(kept):
        levels = F.transform(F.filter(kept, _is_heading), lambda b: b["level"])
        end = F.when(sections, F.repeat(F.lit("\n</section>"), F.element_at(section_closes(levels), -1))).otherwise(F.lit(""))
        return F.concat(join_html(map_headings(kept, values, head, html_body)), end)

    return let(F.filter(blocks, lambda b: b["text"] != ""), body)


def _notes(hrefs: Column) -> Column:
    """``[n]: href`` lines for the distinct hrefs in first-use order (NULL when there are none)."""
    return let(F.array_distinct(hrefs), lambda d: F.when(F.size(d) > 0, F.array_join(F.transform(d, lambda h, i: F.concat(
        F.lit("["), (i + 1).cast("string"), F.lit("]: "), h)), "\n")))


def render_markdown_refs(blocks: Column, links: Column, location: Column, atx: Column) -> Column:
    """B6 with reference links (L2 in the row): the distinct hrefs of the links of each scope, numbered by first use,
    are listed as ``[n]: href`` notes after the scope: the document, each section (level-1 heading) or each block.
    ``links`` is ``link_array`` of the same HTML, so its block numbers are those of ``blocks``. Blocks and links are
    merged by block number into one array and read in order: a link of a block that was removed counts to the section
    it stood in, and has no block to be noted after."""
    from quire.operators.render import markdown_piece

    piece = lambda b: F.when(atx, markdown_piece(b, True)).otherwise(markdown_piece(b, False))
    kept = F.filter(blocks, lambda b: b["text"] != "")

    def event(no, is_link, i, top, text):
        return F.struct(no.cast("int").alias("no"), F.lit(is_link).alias("link"), i.alias("i"), top.alias("top"), text.alias("text"))

    # one event per block (its text null when empty) and per link, in order
    events = F.sort_array(F.concat(
        F.transform(blocks, lambda b, i: event(b["block_no"], 0, i, _is_heading(b) & (b["level"] <= 1),
                                               F.when(b["text"] != "", piece(b)))),
        F.transform(links, lambda lk, i: event(lk["block_no"], 1, i, F.lit(False), lk["href"]))))
    def read(opens, takes):
        """All texts and notes in order. The events are cut into groups, a new one where ``opens`` holds; after the texts of a
        group come the notes of those of its links that ``takes`` counts, given the group's first event."""
        def group(part):
            first = F.get(part, F.lit(0))
            notes = _notes(F.transform(F.filter(part, lambda e: (e["link"] == 1) & takes(first, e)), lambda e: e["text"]))
            return F.filter(F.concat(F.transform(F.filter(part, lambda e: e["link"] == 0), lambda e: e["text"]), F.array(notes)),
                            lambda x: x.isNotNull())

        def grouped(ev):
            return let(F.filter(F.transform(ev, lambda e, i: F.when((i == 0) | opens(e), i)), lambda i: i.isNotNull()), lambda starts: F.flatten(
                F.transform(starts, lambda at, k: let(F.slice(ev, at + 1, F.coalesce(F.get(starts, k + 1), F.size(ev)) - at), group))))

        return F.array_join(let(events, grouped), "\n\n")

    doc_notes = _notes(F.transform(links, lambda lk: lk["href"]))
    in_block = lambda first, e: first["text"].isNotNull() & (first["link"] == 0) & (first["no"] == e["no"])
    return (F.when(location == "block", read(lambda e: e["link"] == 0, in_block))
            .when(location == "section", read(lambda e: e["top"], lambda first, e: F.lit(True)))
            .otherwise(F.concat_ws("\n\n", F.array_join(F.transform(kept, piece), "\n\n"), doc_notes)))
