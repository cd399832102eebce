"""Registered queries: the conversion job with side files (templates, metadata, bibliographies, resources, remote files)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.codecs import b64_encode, html_escape, utf8
from quire.model import JobConfig
from quire.plans import convert as C
from quire.plans import fixtures as X
from quire.plans.queries import _crawl, query
from quire.plans.queries_links import cited_docs
from quire.session import table
from quire.sources.requests import parse_requests

FILES = "f_path string, f_bytes binary"


def requests(docs: DataFrame, **options: Column) -> DataFrame:
    """docs(doc_id, content, ...) as inline conversion requests; an option that is null for a row is not set."""
    params = F.struct(b64_encode(utf8(F.col("content"))).alias("data"))
    conv = F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in options.items()])
    body = F.to_json(F.struct(F.struct(F.lit("data").alias("name"), params.alias("params")).alias("fetcher"), conv.alias("converter")))
    return parse_requests(docs.select(F.col("doc_id").alias("request_id"), body.alias("body")))


def view(out: DataFrame) -> DataFrame:
    return out.select("request_id", F.col("code").cast("bigint").alias("code"), F.col("rule").cast("bigint").alias("rule"), "message",
                      F.md5("outcome.result.data").alias("data_md5"))


def data_uri(text: Column, kind: str = "text/plain") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), b64_encode(utf8(text)))


def file_of(path: Column, text: Column) -> list[Column]:
    return [path.alias("f_path"), utf8(text).alias("f_bytes")]


def own_templates(i: Column) -> Column:
    """A template of its own for every request; every fourth one is left open."""
    n = i.cast("string")
    return (F.when(i % 4 == 0, F.concat(F.lit("T"), n, F.lit(": $title$\n$body$")))
            .when(i % 4 == 1, F.concat(F.lit("$for(author)$$author$$sep$; $endfor$ - $if(draft)$D$else$F"), n, F.lit("$endif$\n$body$")))
            .when(i % 4 == 2, F.concat(F.lit("$for(a)$$for(author)$$a$.$author$"), n, F.lit("$sep$,$endfor$$sep$|$endfor$$$ $missing$$body$")))
            .otherwise(F.concat(F.lit("$if(x)$open "), n)))


@query
def convert_templates(spark, sf_dir):
    """T1 per request: each request names a template of its own (a data URI with its id in it)."""
    i = F.col("doc_id")
    reqs = requests(
        X.markdown_docs(spark, sf_dir), **{"from": "markdown"}, to=F.when(i % 2 == 0, "markdown").otherwise("html"), template=data_uri(own_templates(i)),
        variable=F.create_map(F.lit("title"), F.concat(F.lit("Doc "), i.cast("string"))),
        metadata=F.map_filter(F.create_map(
            F.lit("author"), F.array(F.lit("ann"), F.concat(F.lit("ed"), (i % 5).cast("string"))), F.lit("a"), F.array(F.lit("1"), F.lit("2")),
            F.lit("draft"), F.when(i % 3 == 0, F.array(F.lit("y")))), lambda k, v: v.isNotNull()))
    return view(C.convert_job(reqs, files=spark.createDataFrame([], FILES)))


META_TEMPLATE = "$title$|$for(author)$$author$$sep$;$endfor$|$for(tags)$$tags$$sep$;$endfor$|$lang$|$body$"


def headed_docs(spark, sf_dir):
    """documents as markdown with a metadata block in front (even ids, but for every fourth document) or as HTML with a title
    and meta tags (odd ids)."""
    i = F.col("doc_id")
    n = i.cast("string")
    head = F.concat(F.lit("---\ntitle: Head "), n, F.lit("\nauthor:\n- a"), (i % 3).cast("string"), F.lit('\n- "b c"\ntags: [x, \''), F.col("lang"), F.lit("']\n---\n\n"))
    first = F.substring_index("text", "\n", 1)
    page = F.concat(F.lit("<html><head><title>H "), n, F.lit(' &amp;\n co</title><meta name="author" content="m1"><meta charset="utf-8">'
                                                            "<META content='m&lt;2' name='Author'></head><body><p>"), html_escape(first), F.lit("</p></body></html>"))
    md = X.markdown_docs(spark, sf_dir).withColumnRenamed("content", "md")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text").join(md, "doc_id")
    return d.select("doc_id", F.when(i % 2 == 1, page).when(i % 4 == 0, F.col("md")).otherwise(F.concat(head, "md")).alias("content"))


@query
def convert_document_metadata(spark, sf_dir):
    """T3 in the job: the request (every fifth), its metadata file (every third) and the document itself give the variables
    of the job's template."""
    i = F.col("doc_id")
    side = F.to_json(F.struct(F.array(F.lit("f")).alias("lang"), F.array(F.concat(F.lit("file "), i.cast("string"))).alias("title")))
    reqs = requests(
        headed_docs(spark, sf_dir), **{"from": F.when(i % 2 == 1, "html").otherwise("markdown")}, to="plain", standalone=True,
        variable=F.when(i % 5 == 0, F.create_map(F.lit("title"), F.lit("Asked"))), metadata_file=F.when(i % 3 == 0, data_uri(side, "application/json")))
    return view(C.convert_job(reqs, JobConfig(document_template=META_TEMPLATE), files=spark.createDataFrame([], FILES)))


def bibliography_files(spark, sf_dir):
    """Three bibliographies of the benchmark items, by item_id: two CSL JSON files and a BibTeX one."""
    i = F.col("item_id")
    n = i.cast("string")
    word, year = F.regexp_extract("text", r"^([A-Za-z]+)", 1), (F.lit(2000) + i % 20)
    csl = F.to_json(F.struct(
        F.concat(F.lit("k"), n).alias("id"), word.alias("title"), F.concat(F.lit("Journal "), (i % 4).cast("string")).alias("container-title"),
        F.array(F.struct(F.concat(F.lit("F"), n).alias("family"), F.lit("G").alias("given"))).alias("author"),
        F.struct(F.array(F.array(year)).alias("date-parts")).alias("issued")))
    bib = F.concat(F.lit("@article{k"), n, F.lit(",\n  author = {F"), n, F.lit(", G},\n  title = {"), word, F.lit('},\n  journal = "Journal '),
                   (i % 4).cast("string"), F.lit('",\n  year = '), year.cast("string"), F.lit("\n}\n"))
    k = i % 3
    rows = table(spark, sf_dir, "benchmark").select(k.alias("k"), "item_id", F.when(k < 2, csl).otherwise(bib).alias("e"))
    files = rows.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "e"))), lambda x: x["e"]).alias("es"))
    return files.select(*file_of(bibliography_path(F.col("k")), F.when(
        F.col("k") < 2, F.concat(F.lit("["), F.array_join("es", ",\n"), F.lit("]"))).otherwise(F.array_join("es", "\n"))))


def bibliography_path(k: Column) -> Column:
    return F.concat(F.lit("/app/bib/"), k.cast("string"), F.when(k < 2, ".json").otherwise(".bib"))


def abbreviation_file(spark, sf_dir):
    """Short names of the journals of the items below three quarters of their number of journals."""
    names = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 4).alias("j")).distinct().where("j < 3")
    pair = F.struct(F.concat(F.lit("Journal "), F.col("j").cast("string")).alias("key"), F.concat(F.lit("J"), F.col("j").cast("string")).alias("value"))
    listed = names.agg(F.map_from_entries(F.array_sort(F.collect_list(pair))).alias("m"))
    return listed.select(*file_of(F.lit("/app/abbr.json"), F.to_json(F.struct(F.struct(F.col("m").alias("container-title")).alias("default")))))


def _cited(spark, sf_dir, files, **options):
    i = F.col("doc_id")
    reqs = requests(cited_docs(spark, sf_dir), **{"from": "plain"}, to=F.when(i % 2 == 0, "plain").otherwise("html"),
                    bibliography=F.concat(F.when(i % 4 == 0, "file://").otherwise(""), bibliography_path(i % 3)), fail_if_warnings=i % 7 == 3, **options)
    return view(C.convert_job(reqs, files=files))


@query
def convert_citations(spark, sf_dir):
    """L3 in the job: every request names one of three bibliographies; keys that it lacks stay, and are warnings."""
    return _cited(spark, sf_dir, bibliography_files(spark, sf_dir))


@query
def convert_citation_abbreviations(spark, sf_dir):
    """L3 and L4 in the job: every other request also names an abbreviation file."""
    files = bibliography_files(spark, sf_dir).unionByName(abbreviation_file(spark, sf_dir))
    return _cited(spark, sf_dir, files, citation_abbreviations=F.when(F.col("doc_id") % 2 == 0, "/app/abbr.json"))


SEARCH = "/app/src0/:/app/src1:/etc:/app/src2"


@query
def convert_resource_path(spark, sf_dir):
    """M3 in the job: images of a document are looked for in three folders; each document has a picture in the folder of its
    source, so pictures of other sources are not found."""
    i = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    files = docs.select(*file_of(F.concat(F.lit("/app/"), F.col("source"), F.lit("/img/"), i.cast("string"), F.lit(".png")), F.lit("")))
    n = X.rows_of(spark, sf_dir, "documents")
    own, other = i.cast("string"), ((i * 7) % n).cast("string")
    content = F.concat("text", F.lit("\n\n![own](img/"), own, F.lit(".png) ![other](img/"), other, F.lit('.png "t") ![far](http://a.b/img/1.png) <img src="img/../img/'),
                       own, F.lit('.png">'))
    reqs = requests(docs.select("doc_id", content.alias("content")), **{"from": "plain"}, to="plain", resource_path=SEARCH, fail_if_warnings=i % 7 == 3)
    return view(C.convert_job(reqs, files=files))


@query
def convert_file_schemes(spark, sf_dir):
    """S5 in the job: the text before the body comes from a file, a data URI or a page of the crawl (some were answered with
    404, some are not in it)."""
    i = F.col("doc_id")
    n = X.rows_of(spark, sf_dir, "benchmark")
    ids = X.rows_of(spark, sf_dir, "pages") * 6 // 5
    files = table(spark, sf_dir, "benchmark").select(*file_of(F.concat(F.lit("/app/items/"), F.col("item_id").cast("string")), F.col("text")))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").alias("content")).join(pages, i % ids == F.col("page_id"), "left")
    ref = (F.when(i % 3 == 0, F.concat(F.lit("file:///app/items/"), (i % n).cast("string")))
           .when(i % 3 == 1, data_uri(F.concat(F.lit("<p>in "), F.col("lang"), F.lit("</p>"))))
           .otherwise(F.coalesce("url", F.concat(F.lit("http://missing.example/"), (i % ids).cast("string")))))
    reqs = requests(docs, **{"from": "plain"}, to="html", standalone=True, include_before_body=ref)
    # pages may hold an url several times, so the crawl is not unique: one answer of an url counts
    return view(C.convert_job(reqs, fetch_options={"http": {"crawl": _crawl(spark, sf_dir)}}, files=files))




@query
def convert_distinct_options(spark, sf_dir):
    """E2 with options per row: copies of a text share a conversion only where their options agree."""
    i = F.col("doc_id")
    conv = C.converter_struct(**{"from": "plain"})
    for name, value in (("to", F.when(i % 2 == 0, "plain").otherwise("html")), ("eol", F.when(i % 3 == 0, "crlf")), ("ascii", F.when(i % 5 == 0, False))):
        conv = conv.withField(name, value)
    docs = X.documents_docs(spark, sf_dir).withColumn("conv", conv)
    out = C.convert_distinct(docs, converter="conv")
    return out.select("doc_id", F.md5(utf8(F.col("converted"))).alias("content_md5"))
