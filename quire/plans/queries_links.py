"""Registered queries, step 5: links, citations, media, resources, warnings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.codecs import b64_encode, md5_text, utf8
from quire.operators import links as L
from quire.operators import media as M
from quire.plans import fixtures as X
from quire.plans.queries import query
from quire.session import table

SEARCH_PATH = "static:assets:cdn"


def cited_docs(spark, sf_dir):
    i = F.col("doc_id")
    keys = X.rows_of(spark, sf_dir, "benchmark") * 5 // 4  # a fifth of the keys are not in the bibliography
    c = F.concat(F.col("text"), F.lit(" [@k"), (i % keys).cast("string"), F.lit("] and [@k"), ((i * 7) % keys).cast("string"),
                 F.lit("]"))
    return table(spark, sf_dir, "documents").select("doc_id", c.alias("content"))


def bibliography(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.concat(F.lit("k"), F.col("item_id").cast("string")).alias("key"), F.col("text").alias("entry"))


def media_docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    first = b64_encode(utf8(F.substring_index("text", "\n", 1)))
    tag = b64_encode(utf8(F.concat(F.col("lang"), F.lit("/"), F.col("source"))))
    c = F.concat(F.col("text"), F.lit(" ![a](data:text/plain;base64,"), first, F.lit(") ![b](data:image/png;base64,"), tag,
                 F.lit(")"))
    return d.select("doc_id", c.alias("content"))


def resource_refs(spark, sf_dir):
    lk = L.link_table(X.pages_docs(spark, sf_dir))
    return lk.select("doc_id", "n", F.regexp_replace("href", "^/", "").alias("ref"))


def file_listing(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    w = F.substring_index("text", " ", 1)
    a = d.filter(F.col("doc_id") % 2 == 0).select(F.concat(F.lit("assets/"), w).alias("path"))
    c = d.filter(F.col("doc_id") % 3 == 0).select(F.concat(F.lit("cdn/"), w).alias("path"))
    return a.unionByName(c).distinct()


def _resolved(spark, sf_dir):
    return M.resolve_resources(resource_refs(spark, sf_dir), file_listing(spark, sf_dir), F.lit(SEARCH_PATH))


@query
def link_table(spark, sf_dir):
    return L.link_table(X.pages_docs(spark, sf_dir))


@query
def reference_links(spark, sf_dir):
    return L.reference_links(L.link_table(X.pages_docs(spark, sf_dir)), "document")


@query
def reference_links_block(spark, sf_dir):
    return L.reference_links(L.link_table(X.pages_docs(spark, sf_dir)), "block")


@query
def citations(spark, sf_dir):
    res, _ = L.resolve_citations(L.citation_table(cited_docs(spark, sf_dir)), bibliography(spark, sf_dir))
    return res.select("doc_id", "n", "key", "cite_no", md5_text(F.col("entry")).alias("entry_md5"))


@query
def citations_missing(spark, sf_dir):
    _, miss = L.resolve_citations(L.citation_table(cited_docs(spark, sf_dir)), bibliography(spark, sf_dir))
    return miss.select("doc_id", "key")


@query
def citation_abbreviations(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    container = F.regexp_extract("text", r"^(\S+ \S+)", 1)
    bib = b.select(F.concat(F.lit("k"), F.col("item_id").cast("string")).alias("key"), container.alias("container"))
    abbr = b.filter(F.col("item_id") % 2 == 0).select(
        container.alias("full"), F.concat(F.lit("J"), F.col("item_id").cast("string")).alias("short"))
    abbr = abbr.groupBy("full").agg(F.min("short").alias("short"))
    return L.abbreviate_entries(bib, abbr).select("key", "container")


@query
def extract_media(spark, sf_dir):
    out, _ = M.extract_media(media_docs(spark, sf_dir))
    return out.select("doc_id", md5_text(F.col("content")).alias("content_md5"), F.col("n_media").cast("bigint"))


@query
def extract_media_resources(spark, sf_dir):
    _, res = M.extract_media(media_docs(spark, sf_dir))
    return res.select("md5", "content_type", "path", "n_uses", F.octet_length("data").cast("bigint").alias("n_bytes"))


@query
def self_contained(spark, sf_dir):
    out, res = M.extract_media(media_docs(spark, sf_dir))
    back = M.self_contained(out.select("doc_id", "content"), res)
    return back.select("doc_id", md5_text(F.col("content")).alias("content_md5"))


@query
def resolve_resources(spark, sf_dir):
    return _resolved(spark, sf_dir)


@query
def warnings(spark, sf_dir):
    html = M.html_warnings(X.pages_docs(spark, sf_dir))
    _, miss = L.resolve_citations(L.citation_table(cited_docs(spark, sf_dir)), bibliography(spark, sf_dir))
    cites = miss.select("doc_id", F.lit("unresolved_citation").alias("kind"), F.col("key").alias("detail"))
    res = _resolved(spark, sf_dir).filter(F.col("resolved").isNull()).select(
        "doc_id", F.lit("unresolved_resource").alias("kind"), F.col("ref").alias("detail"))
    return M.warnings(html, cites, res)


def page_sections(spark, sf_dir):
    """block -> section number of every page block (a section starts at each level-1 heading)."""
    from pyspark.sql import Window

    from quire.operators.blocks import html_blocks

    bl = html_blocks(X.pages_docs(spark, sf_dir))
    opens = F.when((F.col("kind") == "heading") & (F.col("level") <= 1), 1).otherwise(0)
    w = Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return bl.select("doc_id", "block_no", F.sum(opens).over(w).alias("section_no"))


@query
def reference_links_section(spark, sf_dir):
    return L.reference_links(L.link_table(X.pages_docs(spark, sf_dir)), "section", page_sections(spark, sf_dir))
