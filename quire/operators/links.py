"""Links, reference links and citations (L1-L4). Definitions are ours; the reference only forwards the options.

Links are read from the same stripped HTML the block splitter uses (no script, style, head or comments), and each
carries the number of the block it sits in, so reference numbering can be scoped to the document, a section or a
block by grouping on ``(doc_id, scope)``; all groupings and windows are keyed by ``doc_id`` first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.codecs import let
from quire.operators.blocks import ENDTAG, HTML_MARK_RE, HTML_STRIP_RE, MARK, unmarked

ANCHOR_RE = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a\s*>"""
CITE_RE = r"\[@([A-Za-z0-9_:.-]+)\]"


def _anchor_text(t: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]*>", " "), r"[ \t\r\n]+", " "))


def link_array(html: Column) -> Column:
    """array<struct<block_no, href, text>> in document order; block 0 = before the first block tag."""
    s = F.regexp_replace(F.regexp_replace(unmarked(html), HTML_STRIP_RE, ""), HTML_MARK_RE, MARK + "$1" + ENDTAG)
    pieces = F.split(s, MARK, -1)

    def per_piece(p, i):
        hrefs = F.regexp_extract_all(p, F.lit(ANCHOR_RE), 1)
        texts = F.regexp_extract_all(p, F.lit(ANCHOR_RE), 2)
        return F.zip_with(hrefs, texts, lambda h, t: F.struct(i.cast("int").alias("block_no"), h.alias("href"),
                                                              _anchor_text(t).alias("text")))

    return F.flatten(F.transform(pieces, per_piece))


def link_table(docs: DataFrame, content: str = "content") -> DataFrame:
    """L1: (doc_id, n, block_no, href, text), ``n`` = 1-based position in the document."""
    return docs.select("doc_id", F.posexplode(link_array(F.col(content))).alias("pos", "l")).select(
        "doc_id", (F.col("pos") + 1).cast("int").alias("n"), "l.block_no", "l.href", "l.text")


def reference_links(links: DataFrame, location: str = "document", sections: DataFrame | None = None) -> DataFrame:
    """L2: distinct hrefs numbered by first use within the scope; one note row per (scope, href).

    location: ``document`` (scope 0), ``block`` (scope = block_no) or ``section`` (scope = section number of the
    link's block, from ``sections(doc_id, block_no, section_no)``)."""
    if location == "document":
        scoped = links.withColumn("scope", F.lit(0))
    elif location == "block":
        scoped = links.withColumn("scope", F.col("block_no"))
    elif location == "section":
        if sections is None:
            raise ValueError("section scope needs the block -> section table")
        scoped = links.join(sections, ["doc_id", "block_no"], "left").withColumn(
            "scope", F.coalesce(F.col("section_no"), F.lit(0)))
    else:
        raise ValueError(f"unknown reference_location {location!r}")
    first = scoped.groupBy("doc_id", "scope", "href").agg(F.min("n").alias("first_n"))
    w = Window.partitionBy("doc_id", "scope").orderBy("first_n")
    return first.select("doc_id", F.col("scope").cast("bigint").alias("scope"),
                        F.row_number().over(w).cast("bigint").alias("ref_no"), "href", "first_n")


def citation_table(docs: DataFrame, content: str = "content") -> DataFrame:
    """Every ``[@key]`` occurrence: (doc_id, n, key)."""
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.col(content), F.lit(CITE_RE), 1))
                       .alias("pos", "key")).select("doc_id", (F.col("pos") + 1).cast("int").alias("n"), "key")


def resolve_citations(cites: DataFrame, bib: DataFrame) -> tuple[DataFrame, DataFrame]:
    """L3: (resolved, missing). Resolved occurrences join the bibliography ``(key, entry)`` and are numbered by first
    use in the document; missing = distinct keys of a document with no entry (left anti join). The join strategy is
    left to AQE: broadcast when the bibliography turns out small at run time, sort-merge otherwise."""
    known = cites.join(bib, "key")
    first_n = F.min("n").over(Window.partitionBy("doc_id", "key"))
    resolved = known.withColumn("first_n", first_n).withColumn(
        "cite_no", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("first_n")).cast("int")).drop("first_n")
    missing = cites.select("doc_id", "key").distinct().join(bib.select("key"), "key", "left_anti")
    return resolved, missing


def abbreviate_entries(bib: DataFrame, abbr: DataFrame, field: str = "container") -> DataFrame:
    """L4: replace ``field`` by its short form where ``abbr(full, short)`` lists it."""
    a = abbr.select(F.col("full").alias("a_full"), F.col("short").alias("a_short"))
    j = bib.join(a, bib[field] == a["a_full"], "left")
    return j.withColumn(field, F.coalesce(F.col("a_short"), F.col(field))).drop("a_full", "a_short")


# --- bibliographies of a conversion job ---------------------------------------------------------------------------

_CSL = ("array<struct<id:string,title:string,`container-title`:string,author:array<struct<family:string,given:string,"
        "literal:string>>,issued:struct<`date-parts`:array<array<string>>>>>")
_ENTRY_RE = r"(?s)@[A-Za-z]+\s*\{\s*([^,\s{}]+)\s*,(.*?)\n\s*\}"


def _bib_field(body: Column, *names: str) -> Column:
    """The first of the named fields of a BibTeX entry that is set: ``name = {..}``, ``"..."`` or a number."""
    found = []
    for name in names:
        field = r"(?i)(?:^|[\s,])" + name + r"\s*=\s*(?:\{([^{}]*)\}|\"([^\"]*)\"|([0-9]+))"
        found += [F.nullif(F.trim(F.regexp_replace(F.regexp_extract(body, field, k), r"\s+", " ")), F.lit("")) for k in (1, 2, 3)]
    return F.coalesce(*found)


def bibliography_entries(files: DataFrame) -> DataFrame:
    """``files(source, text)`` -> (source, key, author, title, container, year). A text that starts with ``[`` is CSL JSON (id,
    author, title, container-title, issued), any other BibTeX (author, title, journal or booktitle, year); empty fields are
    not set. Of entries with one key the first of the file counts. A file that is neither gives no entry."""
    text = F.trim(F.regexp_replace("text", "^\ufeff", ""))
    names = lambda a: F.array_join(F.transform(a, lambda x: F.coalesce(x["literal"], F.concat_ws(", ", x["family"], x["given"]))), " and ")
    row = lambda key, author, title, container, year: F.struct(
        key.alias("key"), *[F.nullif(v, F.lit("")).alias(k) for k, v in (("author", author), ("title", title), ("container", container), ("year", year))])
    csl = F.transform(F.from_json(text, _CSL), lambda e: row(
        e["id"], names(e["author"]), e["title"], e["container-title"], F.get(F.get(e["issued"]["date-parts"], F.lit(0)), F.lit(0))))
    bodies = F.regexp_extract_all(text, F.lit(_ENTRY_RE), 2)
    bib = F.zip_with(F.regexp_extract_all(text, F.lit(_ENTRY_RE), 1), bodies, lambda key, b: row(
        key, _bib_field(b, "author"), _bib_field(b, "title"), _bib_field(b, "journal", "booktitle"), _bib_field(b, "year")))
    entries = files.select("source", F.posexplode(F.when(text.startswith("["), csl).otherwise(bib)).alias("at", "e"))
    return entries.where("e.key is not null").groupBy("source", F.col("e.key").alias("key")).agg(
        F.min_by("e", "at").alias("e")).select("source", "key", "e.author", "e.title", "e.container", "e.year")


def abbreviation_entries(files: DataFrame) -> DataFrame:
    """``files(source, text)`` -> (source, full, short) of a CSL abbreviation file: {"default": {"container-title": {..}}}."""
    listed = F.from_json("text", "map<string,map<string,map<string,string>>>")
    found = F.try_element_at(F.try_element_at(listed, F.lit("default")), F.lit("container-title"))
    return files.select("source", F.explode(found).alias("full", "short")).groupBy("source", "full").agg(F.min("short").alias("short"))


def entry_text(author: Column, title: Column, container: Column, year: Column) -> Column:
    return F.concat(F.concat_ws(". ", *[F.regexp_replace(c, r"\.$", "") for c in (author, title, container, year)]), F.lit("."))


def citation_entries(pairs: DataFrame, bib: DataFrame, abbr: DataFrame) -> DataFrame:
    """L4 composed with L3: ``pairs(bib_id, abbr_id)``, the distinct pairs of files that requests name (``abbr_id`` may be
    null) -> (bib_id, abbr_id, key, entry), the container's name shortened where the pair's second file lists it."""
    named = pairs.join(bib.withColumnRenamed("source", "bib_id"), "bib_id")
    short = abbr.select(F.col("source").alias("a_id"), F.col("full").alias("a_full"), "short")
    j = named.join(short, (F.col("abbr_id") == F.col("a_id")) & (F.col("container") == F.col("a_full")), "left")
    return j.select("bib_id", "abbr_id", "key", entry_text(F.col("author"), F.col("title"), F.coalesce("short", "container"), F.col("year")).alias("entry"))


def cited_keys(text: Column) -> Column:
    """The distinct keys of the ``[@key]`` citations of a text, by first use."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CITE_RE), 1))


def cite_in_text(text: Column, entries: Column) -> Column:
    """Each ``[@key]`` with an entry (``entries``: map key -> text) becomes ``[n]``, n by first use; others stay."""
    known = lambda ks: F.filter(ks, lambda k: F.try_element_at(entries, k).isNotNull())
    keys = F.regexp_extract_all(text, F.lit(CITE_RE), 1)
    return let(known(F.array_distinct(keys)), lambda ks: F.array_join(F.zip_with(F.split(text, CITE_RE, -1), keys, lambda part, k: F.concat(
        part, F.when(k.isNull(), "").when(F.array_position(ks, k) > 0, F.concat(F.lit("["), F.array_position(ks, k).cast("string"), F.lit("]")))
        .otherwise(F.concat(F.lit("[@"), k, F.lit("]"))))), ""))


def reference_list(text: Column, entries: Column) -> Column:
    """The entries of the citations of a text, by first use (array of string)."""
    return F.filter(F.transform(cited_keys(text), lambda k: F.try_element_at(entries, k)), lambda e: e.isNotNull())


def missing_citations(text: Column, entries: Column) -> Column:
    return F.exists(cited_keys(text), lambda k: F.try_element_at(entries, k).isNull())
