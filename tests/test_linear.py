"""The in-row option operators on one large document: time grows about with its size, and results are the plain ones."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from quire.operators import inrow as I
from quire.operators import render as R

LINKS = "array<struct<block_no:int,href:string>>"


def blocks(spark, n, kind):
    """n blocks of a kind; headings of levels 1, 2, 3 and few different texts; a link in each block."""
    rows = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(
        i.cast("int").alias("block_no"), F.lit(kind).alias("kind"), (F.when(F.lit(kind) == "heading", i % 3 + 1).otherwise(0)).cast("int").alias("level"),
        F.concat(F.lit("Title "), (i % 50).cast("string")).alias("text"))).alias("b"), F.transform(
            F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(i.cast("int").alias("block_no"), F.concat(F.lit("u"), (i % 700).cast("string")).alias("href"))).alias("l"))
    return spark.createDataFrame(rows.collect(), rows.schema)


CASES = {
    "number": ("heading", lambda b, l: I.number_headings(b, F.lit(0))),
    "ids": ("heading", lambda b, l: F.array_join(I.heading_ids(b, F.lit("p-")), ",")),
    "html ids": ("heading", lambda b, l: I.render_html_ids(b, F.lit("p-"), F.lit(True))),
    "toc": ("heading", lambda b, l: R.render_html(I.with_toc(b, F.lit(3)))),
    "items": ("item", lambda b, l: R.render_html(b)),
    "section notes": ("heading", lambda b, l: I.render_markdown_refs(b, l, F.lit("section"), F.lit(True))),
    "block notes": ("item", lambda b, l: I.render_markdown_refs(b, l, F.lit("block"), F.lit(True))),
}


@pytest.mark.parametrize("name", CASES)
def test_large_document(spark, name):
    kind, op = CASES[name]
    took = []
    for n in (50, 2000, 4000, 8000):
        df = blocks(spark, n, kind).select(op(F.col("b"), F.col("l")).alias("x"))
        df.collect()
        began = time.perf_counter()
        df.collect()
        took.append(time.perf_counter() - began)
    assert took[1] < 5 and took[2] < 3 * took[1] + 0.5 and took[3] < 3 * took[2] + 0.5, took


def test_notes_by_scope(spark):
    rows = [(1, [(-1, "item", 1, "A"), (0, "para", 0, "lead"), (1, "heading", 1, "A"), (2, "para", 0, ""), (4, "para", 0, "p"), (5, "heading", 1, "B")],
             [(0, "u0"), (1, "u1"), (2, "u2"), (3, "gone"), (3, "gone2"), (4, "u1"), (4, "u4"), (5, "u1")])]
    df = spark.createDataFrame(rows, "k int, b array<struct<block_no:int,kind:string,level:int,text:string>>, l " + LINKS)
    got = {w: df.select(I.render_markdown_refs(F.col("b"), F.col("l"), F.lit(w), F.lit(True))).first()[0]
           for w in ("document", "section", "block")}
    assert got["section"] == ("- A\n\nlead\n\n[1]: u0\n\n# A\n\np\n\n[1]: u1\n[2]: u2\n[3]: gone\n[4]: gone2\n[5]: u4\n\n# B\n\n[1]: u1")
    assert got["block"] == "- A\n\nlead\n\n[1]: u0\n\n# A\n\n[1]: u1\n\np\n\n[1]: u1\n[2]: u4\n\n# B\n\n[1]: u1"
    assert got["document"].endswith("# B\n\n[1]: u0\n[2]: u1\n[3]: u2\n[4]: gone\n[5]: gone2\n[6]: u4")
