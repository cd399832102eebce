"""Registered queries, step 3: rendering to markdown / html and the normalisation stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.codecs import md5_text
from quire.operators import blocks as B
from quire.operators import normalize as N
from quire.operators import render as R
from quire.plans import fixtures as X
from quire.plans.queries import query
from quire.session import table

ABBREVIATIONS = ("Is", "Re", "Dr.", "e.g.")
NORMALIZE_OPTS = N.NormalizeOptions(abbreviations=ABBREVIATIONS)


def _md5(c):
    return md5_text(c).alias("content_md5")


def tabbed_benchmark(spark, sf_dir):
    """benchmark texts with every third blank turned into a tab."""
    words = F.split(F.col("text"), " ", -1)
    joined = F.array_join(
        F.transform(words, lambda w, i: F.when(i == 0, w).when(i % 3 == 0, F.concat(F.lit("\t"), w))
                    .otherwise(F.concat(F.lit(" "), w))), "")
    return table(spark, sf_dir, "benchmark").select("item_id", joined.alias("content"))


def tracked_benchmark(spark, sf_dir):
    """benchmark texts with the first word inserted and the second deleted (tracked changes)."""
    t = F.regexp_replace(F.col("text"), r"^(\S+) (\S+)", "<ins>$1</ins> <del>$2</del>")
    return table(spark, sf_dir, "benchmark").select("item_id", t.alias("content"))


@query
def strip_comments(spark, sf_dir):
    d = X.pages_docs(spark, sf_dir)
    s = N.strip_comments(F.col("content"))
    return d.select("doc_id", _md5(s), (F.length("content") - F.length(s)).cast("bigint").alias("n_removed"))


@query
def html_to_markdown(spark, sf_dir):
    """Table path with setext headings (atx off)."""
    bl = B.strip_empty_paragraphs(B.html_blocks(X.pages_docs(spark, sf_dir)))
    return R.assemble(bl).select("doc_id", _md5(R.render_markdown(F.col("blocks"), atx=False)))


@query
def markdown_atx(spark, sf_dir):
    """In-row path: markdown in, atx markdown out."""
    d = X.markdown_docs(spark, sf_dir)
    return d.select("doc_id", _md5(R.render_markdown(B.markdown_block_array(F.col("content")), atx=True)))


@query
def text_to_html(spark, sf_dir):
    bl = B.text_blocks(X.markdown_docs(spark, sf_dir), "markdown")
    return R.assemble(bl).select("doc_id", _md5(R.render_html(F.col("blocks"))))


@query
def expand_tabs(spark, sf_dir):
    d = tabbed_benchmark(spark, sf_dir)
    e = N.expand_tabs(F.col("content"), 4)
    return d.select("item_id", _md5(e), F.length(e).cast("bigint").alias("n_chars"))


@query
def eol_crlf(spark, sf_dir):
    d = X.documents_docs(spark, sf_dir)
    e = N.eol(F.col("content"), "crlf")
    return d.select("doc_id", _md5(e), F.length(e).cast("bigint").alias("n_chars"))


@query
def wrap_auto(spark, sf_dir):
    d = X.documents_docs(spark, sf_dir)
    w = N.wrap(F.col("content"), "auto", 72)
    lines = F.split(w, "\n", -1)
    return d.select("doc_id", _md5(w), F.size(lines).cast("bigint").alias("n_lines"),
                    F.array_max(F.transform(lines, lambda x: F.length(x))).cast("bigint").alias("max_line"))


@query
def wrap_none(spark, sf_dir):
    d = X.documents_docs(spark, sf_dir)
    return d.select("doc_id", _md5(N.wrap(F.col("content"), "none")))


@query
def ascii_refs(spark, sf_dir):
    d = X.documents_docs(spark, sf_dir)
    a = N.ascii_refs(F.col("content"))
    return d.select("doc_id", _md5(a), F.length(a).cast("bigint").alias("n_chars"))


@query
def email_refs(spark, sf_dir):
    d = X.documents_docs(spark, sf_dir)
    return d.select("doc_id", _md5(N.email_refs(F.col("content"))))


@query
def abbreviations(spark, sf_dir):
    d = X.documents_docs(spark, sf_dir)
    return d.select("doc_id", _md5(N.abbreviations(F.col("content"), ABBREVIATIONS)))


@query
def track_accept(spark, sf_dir):
    d = tracked_benchmark(spark, sf_dir)
    return d.select("item_id", N.track_changes(F.col("content"), "accept").alias("content"))


@query
def track_reject(spark, sf_dir):
    d = tracked_benchmark(spark, sf_dir)
    return d.select("item_id", N.track_changes(F.col("content"), "reject").alias("content"))


@query
def normalize_corpus(spark, sf_dir):
    n = N.normalize_corpus(X.documents_docs(spark, sf_dir), NORMALIZE_OPTS)
    return n.select("doc_id", _md5(F.col("content")), F.array_join("changed", ",").alias("changed"))


@query
def normalize_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("content"))
    return N.normalize_summary(N.normalize_corpus(docs, NORMALIZE_OPTS, keep=("source",)))
