"""Outline operators over the block table (O1-O6). Definitions are ours; the reference only forwards the options.

Every window is partitioned by ``doc_id`` (never over the whole corpus) and ordered by ``block_no``; operators that
need two passes use the same window spec twice, so Spark sorts once. Groupings by ``(doc_id, x)`` after such a window
reuse its ``doc_id`` hash partitioning and add no shuffle. ``by`` names the columns of one numbering: the document, or
``PARTS`` (document and part) for combined documents with ``file_scope``, whose inputs keep numberings of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.render import render_plain

MAX_LEVEL = 6
DOCUMENT, PARTS = ("doc_id",), ("doc_id", "part")


def doc_window(by: tuple[str, ...] = DOCUMENT):
    return Window.partitionBy(*by).orderBy("block_no")


def running(by: tuple[str, ...] = DOCUMENT):
    return doc_window(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def shift_headings(blocks: DataFrame, base: int) -> DataFrame:
    """O1: heading level + base - 1 (base 0 = unset = no shift); a level above 6 makes the block a paragraph."""
    if base == 0:
        return blocks
    new = F.greatest(F.col("level") + base - 1, F.lit(1))  # a negative base never gives a level below 1
    head = F.col("kind") == "heading"
    demote = head & (new > MAX_LEVEL)
    return blocks.withColumns({
        "kind": F.when(demote, F.lit("para")).otherwise(F.col("kind")),
        "level": F.when(demote, F.lit(0)).when(head, new).otherwise(F.col("level")).cast("int"),
    })


def number_sections(blocks: DataFrame, offset: int = 0, by: tuple[str, ...] = DOCUMENT) -> DataFrame:
    """O2: counter path ``1.2.3`` for every heading. A heading resets the counters of all deeper levels; ``offset`` is
    added to the level-1 counter; missing intermediate levels show as 0.

    counter_k = (level-k headings so far) - (that count at the last heading shallower than k)."""
    h = blocks.filter(F.col("kind") == "heading").select(*by, "block_no", "level", "text")
    # one select per pass: Spark evaluates all window functions of a select with the same spec in one operator
    h = h.select("*", *[F.sum(F.when(F.col("level") == k, 1).otherwise(0)).over(running(by)).alias(f"cum{k}")
                        for k in range(1, MAX_LEVEL + 1)])
    h = h.select("*", *[F.coalesce(F.last(F.when(F.col("level") < k, F.col(f"cum{k}")), ignorenulls=True)
                                   .over(running(by)), F.lit(0)).alias(f"base{k}") for k in range(2, MAX_LEVEL + 1)])
    parts = [F.when(F.col("level") >= 1, (F.col("cum1") + offset).cast("string"))]
    parts += [F.when(F.col("level") >= k, (F.col(f"cum{k}") - F.col(f"base{k}")).cast("string"))
              for k in range(2, MAX_LEVEL + 1)]
    return h.select(*by, "block_no", "level", "text", F.concat_ws(".", *parts).alias("number"))


def slug(text: Column) -> Column:
    """ASCII slug: lower case, only ``[a-z0-9_ -]`` kept, blank runs -> ``-``, leading non-letters dropped,
    empty -> ``section``."""
    s = F.regexp_replace(F.lower(text), r"[^a-z0-9_ -]", "")
    s = F.regexp_replace(F.trim(s), " +", "-")
    s = F.regexp_replace(s, "^[^a-z]+", "")
    return F.when(s == "", F.lit("section")).otherwise(s)


def header_ids(blocks: DataFrame, prefix: str = "", by: tuple[str, ...] = DOCUMENT) -> DataFrame:
    """O3: one id per heading; repeats within a document (a part, with ``PARTS``) get ``-1``, ``-2`` in order; ``prefix`` in front."""
    h = blocks.filter(F.col("kind") == "heading").withColumn("slug", slug(F.col("text")))
    n = F.row_number().over(Window.partitionBy(*by, "slug").orderBy("block_no")) - 1
    ident = F.when(n == 0, F.col("slug")).otherwise(F.concat(F.col("slug"), F.lit("-"), n.cast("string")))
    return h.select(*by, "block_no", "level", "text", F.concat(F.lit(prefix), ident).alias("id"))


def toc(blocks: DataFrame, depth: int = 3, by: tuple[str, ...] = DOCUMENT) -> DataFrame:
    """Per document, the headings of level <= depth in order, as a nested dash list (two blanks per level)."""
    h = blocks.filter((F.col("kind") == "heading") & (F.col("level") <= depth))
    entries = F.array_sort(F.collect_list(F.struct("block_no", "level", "text")))
    line = lambda e: F.concat(F.repeat(F.lit("  "), e["level"] - 1), F.lit("- "), e["text"])
    return h.groupBy(*by).agg(entries.alias("e")).select(
        *by, F.size("e").cast("bigint").alias("n_entries"), F.array_join(F.transform("e", line), "\n").alias("toc")
    )


def split_sections(blocks: DataFrame, level: int = 1, unit: str = "section", by: tuple[str, ...] = DOCUMENT) -> DataFrame:
    """A section starts at each heading of level <= ``level``; section 0 is the preamble. One row per section:
    title (the opening heading), block count and the plain text of its other blocks. Serves section_divs,
    top_level_division (unit label), epub_chapter_level and slide_level."""
    opens = (F.col("kind") == "heading") & (F.col("level") <= level)
    b = blocks.withColumn("section_no", F.sum(F.when(opens, 1).otherwise(0)).over(running(by))).withColumn("opens", opens)
    g = b.groupBy(*by, "section_no").agg(
        F.max(F.when(F.col("opens"), F.col("text"))).alias("title"),
        F.count(F.lit(1)).alias("n_blocks"),
        F.array_sort(F.collect_list(F.struct("block_no", "kind", "level", "text", "opens"))).alias("bl"),
    )
    body = F.filter("bl", lambda x: ~x["opens"])
    return g.select(
        *by, F.col("section_no").cast("bigint").alias("section_no"), F.lit(unit).alias("unit"), "title",
        "n_blocks", render_plain(body).alias("text"),
    )


def concat_documents(parts: DataFrame, by: str, order: str, text: str = "text", sep: str = "\n\n",
                     bucket_width: int = 1024) -> DataFrame:
    """Many documents -> one per key, in ``order`` (numeric). A combined document is one row, like any document.

    Two levels, so a key holding a large share of all parts is not gathered as one list in one task: parts are
    first joined within ranges of ``order`` (``floor(order / bucket_width)``, which spreads a hot key over many
    tasks and keeps the order between ranges), then the range texts are joined per key."""
    bucket = F.floor(F.col(order) / bucket_width)
    s1 = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    level1 = parts.groupBy(by, bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.transform(s1, lambda x: x["t"]), sep).alias("t"))
    s2 = F.array_sort(F.collect_list(F.struct("bucket", "t")))
    return level1.groupBy(by).agg(F.sum("n").cast("bigint").alias("n_parts"), s2.alias("p")).select(
        by, "n_parts", F.array_join(F.transform("p", lambda x: x["t"]), sep).alias("text"))


def concat_blocks(blocks: DataFrame, groups: DataFrame, by: str, order: str, file_scope: bool) -> DataFrame:
    """O6 on block tables: ``groups(doc_id, by, order)`` maps input documents into combined ones.

    file_scope=false: one numbering runs over the combined document (so ids and section numbers run across
    inputs): ``block_no`` becomes the order key ``part * 2^32 + block_no`` (gaps allowed, as after B4), computed in
    the row, so no window has to hold a whole combined document; true: block numbers stay per input and the input's
    position is kept in ``part``; number such blocks with ``by=PARTS``, and order them by ``part``, then ``block_no``."""
    j = blocks.join(groups, "doc_id")
    if file_scope:
        return j.select(F.col(by).alias("doc_id"), F.col(order).alias("part"), "block_no", "kind", "level", "text")
    key = F.shiftleft(F.col(order).cast("bigint"), 32) + F.col("block_no").cast("bigint")
    return j.select(F.col(by).alias("doc_id"), F.col(order).alias("part"), key.alias("block_no"), "kind", "level",
                    "text")
