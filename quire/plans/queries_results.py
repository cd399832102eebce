"""Registered queries, step 6-7: the conversion job, outcomes and their renderings, templates, metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.codecs import b64_encode, md5_text, utf8
from quire.operators import templates as T
from quire.operators.results import outcome_summary as _summary
from quire.operators.results import render_binary, render_default, render_embed
from quire.plans import convert as C
from quire.plans import fixtures as X
from quire.plans.queries import _crawl, _requests, query
from quire.session import table

TEMPLATE = (
    "$if(title)$# $title$\n$endif$"
    "By $for(author)$$author$$sep$, $endfor$.\n"
    "$if(keywords)$Keywords: $for(keywords)$[$keywords$]$sep$; $endfor$$else$No keywords$endif$\n"
    "$if(lang)$$if(author)$lang=$lang$ by $author$$else$lang only$endif$$endif$\n"
    "$for(author)$$if(author)$<$author$>$endif$$endfor$ $$5 $missing-var$|$if(missing-var)$x$else$y$endif$\n"
    "$body$"
)


def _outcomes(spark, sf_dir):
    return C.convert_job(_requests(spark, sf_dir), fetch_options={"http": {"crawl": _crawl(spark, sf_dir), "unique": True}})


@query
def convert_requests(spark, sf_dir):
    return C.outcome_view(_outcomes(spark, sf_dir))


@query
def envelope(spark, sf_dir):
    o = _outcomes(spark, sf_dir)
    return o.select("request_id", F.col("outcome.code").cast("bigint").alias("code"), F.col("outcome.message")
                    .alias("message"), F.col("outcome.result").isNotNull().alias("has_result"),
                    F.md5("outcome.result.data").alias("data_md5"))


@query
def select_template(spark, sf_dir):
    return _outcomes(spark, sf_dir).select("request_id", "template", "template_used")


@query
def render_default_json(spark, sf_dir):
    o = _outcomes(spark, sf_dir)
    return o.select("request_id", md5_text(render_default(F.col("outcome"))).alias("response_md5"))


@query
def render_embed_html(spark, sf_dir):
    o = _outcomes(spark, sf_dir)
    return o.select("request_id", md5_text(render_embed(F.col("outcome"), F.col("dst_format"))).alias("response_md5"))


@query
def render_binary_body(spark, sf_dir):
    o = _outcomes(spark, sf_dir)
    b = render_binary(F.col("outcome"), F.col("dst_format"))
    return o.select("request_id", b["status"].cast("bigint").alias("status"), b["content_type"].alias("content_type"),
                    F.md5(b["body"]).alias("body_md5"))


@query
def outcome_summary(spark, sf_dir):
    o = _outcomes(spark, sf_dir).select("driver", "dst_format", F.col("code").cast("bigint").alias("code"),
                                         F.col("rule").cast("bigint").alias("rule"))
    return _summary(o, "driver", "dst_format", "code", "rule")


def _entries(*items):
    """Long rows from one row: ``items`` are (condition, struct) pairs; one generator, one scan."""
    return F.filter(F.array(*[F.when(c, e) for c, e in items]), lambda x: x.isNotNull())


def template_vars_long(spark, sf_dir):
    """(doc_id, name, ord, value) variables of every document, read in one scan."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")

    def e(name, ord_, value):
        return F.struct(F.lit(name).alias("name"), F.lit(ord_).cast("int").alias("ord"), value.alias("value"))

    words = F.split("text", " ")
    items = [
        (F.lit(True), e("title", 0, F.substring_index("text", "\n", 1))),
        (i % 7 != 0, e("lang", 0, F.col("lang"))),
        (F.lit(True), e("author", 0, F.col("source"))),
        (i % 3 != 0, e("author", 1, F.concat(F.lit("editor-"), (i % 5).cast("string")))),
    ]
    items += [((i % 2 == 0) & (F.size(words) > k), e("keywords", k, F.element_at(words, k + 1))) for k in range(3)]
    items.append((i % 11 == 0, e("keywords", 9, F.lit(""))))
    return d.select("doc_id", F.inline(_entries(*items)))


@query
def template_render(spark, sf_dir):
    v = T.gather_vars(template_vars_long(spark, sf_dir))
    r = T.template_render(X.documents_docs(spark, sf_dir), v, TEMPLATE)
    return r.select("doc_id", md5_text(F.col("rendered")).alias("rendered_md5"),
                    F.length("rendered").cast("bigint").alias("n_chars"))


@query
def includes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    inc = d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select(
        "lang", F.concat(F.lit('<meta name="lang" content="'), F.col("lang"), F.lit('">')).alias("header"),
        F.concat(F.lit("<p>Start "), F.col("lang"), F.lit(" ("), F.col("n").cast("string"), F.lit(")</p>"))
        .alias("before"), F.lit("<p>End</p>").alias("after"))
    j = d.join(inc, "lang", "left")
    html = C.R.render_html(C.B.plain_block_array(F.col("text")))
    page = T.includes(html, F.col("header"), F.col("before"), F.col("after"), True,
                      F.substring_index("text", "\n", 1))
    return j.select("doc_id", md5_text(page).alias("page_md5"))


def metadata_long(spark, sf_dir):
    """(doc_id, key, value, priority, ord) from three sources: 1 request, 2 metadata file (labels), 3 document."""
    d = table(spark, sf_dir, "documents")
    lb = table(spark, sf_dir, "labels")
    i = F.col("doc_id")

    def e(key, value, prio, ord_=0):
        return F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"), F.lit(prio).alias("priority"),
                        F.lit(ord_).cast("int").alias("ord"))

    doc_rows = d.select("doc_id", F.inline(_entries(
        (F.lit(True), e("title", F.substring_index("text", "\n", 1), 3)),
        (F.lit(True), e("lang", F.col("lang"), 3)),
        (F.lit(True), e("source", F.col("source"), 3)),
        (i % 5 == 0, e("title", F.concat(F.lit("Request "), i.cast("string")), 1)),
        (i % 2 == 0, e("tags", F.col("lang"), 1, 0)),
        (i % 2 == 0, e("tags", F.col("source"), 1, 1)),
    )))
    label_rows = lb.select("doc_id", F.inline(_entries(
        (F.lit(True), e("quality", F.col("quality"), 2)),
        (F.lit(True), e("toxic", F.col("toxic"), 2)),
        (F.col("quality") == 1, e("lang", F.lit("xx"), 2)),
    )))
    return doc_rows.unionByName(label_rows)


@query
def merge_metadata(spark, sf_dir):
    m = T.merge_metadata(metadata_long(spark, sf_dir), title_prefix="Corpus")
    return m.select("doc_id", "key", F.col("source_priority").cast("bigint").alias("source_priority"),
                    F.size("values").cast("bigint").alias("n_values"), F.array_join("values", "|").alias("value"))


@query
def convert_distinct(spark, sf_dir):
    c = C.convert_distinct(X.documents_docs(spark, sf_dir), "plain", "html")
    return c.select("doc_id", md5_text(F.col("converted")).alias("content_md5"))



def option_request_bodies(spark, sf_dir):
    """Requests over the markdown documents with per-request options: number_sections (id % 3 = 0, offset id % 2),
    atx headers, to markdown / html (id % 2), ascii (id % 7 = 0), crlf line ends (id % 5 = 0)."""
    md = X.markdown_docs(spark, sf_dir)
    i = F.col("doc_id")
    flag = lambda c: F.when(c, F.lit("true")).otherwise(F.lit("false"))
    conv = F.concat(
        F.lit('{"from":"markdown","to":"'), F.when(i % 2 == 0, F.lit("markdown")).otherwise(F.lit("html")),
        F.lit('","atx_headers":true,"number_sections":'), flag(i % 3 == 0),
        F.lit(',"number_offset":'), (i % 2).cast("string"), F.lit(',"ascii":'), flag(i % 7 == 0),
        F.lit(',"eol":"'), F.when(i % 5 == 0, F.lit("crlf")).otherwise(F.lit("lf")), F.lit('"}'))
    payload = b64_encode(utf8(F.col("content")))
    body = F.concat(F.lit('{"fetcher":{"name":"data","params":{"data":"'), payload, F.lit('"}},"converter":'),
                    conv, F.lit("}"))
    return md.select(i.alias("request_id"), body.alias("body"))


@query
def convert_options(spark, sf_dir):
    from quire.sources.requests import parse_requests

    out = C.convert_job(parse_requests(option_request_bodies(spark, sf_dir)))
    return out.select("request_id", F.col("code").cast("bigint").alias("code"),
                      F.md5("outcome.result.data").alias("data_md5"))


def option_request_bodies_2(spark, sf_dir):
    """Requests over the markdown documents: to html when id % 3 = 0 (heading ids with prefix ``x-`` when id is even),
    else markdown with atx headings, a toc of depth 2 when id is even, and wrap none when id % 4 = 1."""
    md = X.markdown_docs(spark, sf_dir)
    i = F.col("doc_id")
    flag = lambda c: F.when(c, F.lit("true")).otherwise(F.lit("false"))
    conv = F.concat(
        F.lit('{"from":"markdown","to":"'), F.when(i % 3 == 0, F.lit("html")).otherwise(F.lit("markdown")),
        F.lit('","atx_headers":true,"toc":'), flag(i % 2 == 0), F.lit(',"toc_depth":2,"id_prefix":"'),
        F.when(i % 2 == 0, F.lit("x-")).otherwise(F.lit("")), F.lit('","wrap":"'),
        F.when(i % 4 == 1, F.lit("none")).otherwise(F.lit("preserve")), F.lit('"}'))
    payload = b64_encode(utf8(F.col("content")))
    body = F.concat(F.lit('{"fetcher":{"name":"data","params":{"data":"'), payload, F.lit('"}},"converter":'),
                    conv, F.lit("}"))
    return md.select(i.alias("request_id"), body.alias("body"))


@query
def convert_options_2(spark, sf_dir):
    from quire.sources.requests import parse_requests

    out = C.convert_job(parse_requests(option_request_bodies_2(spark, sf_dir)))
    return out.select("request_id", F.col("code").cast("bigint").alias("code"),
                      F.md5("outcome.result.data").alias("data_md5"))


def option_request_bodies_3(spark, sf_dir):
    """Requests over the markdown documents to html with section_divs; number_sections when the id is even and
    base_header_level 2 when id % 5 = 0."""
    md = X.markdown_docs(spark, sf_dir)
    i = F.col("doc_id")
    flag = lambda c: F.when(c, F.lit("true")).otherwise(F.lit("false"))
    conv = F.concat(
        F.lit('{"from":"markdown","to":"html","section_divs":true,"number_sections":'), flag(i % 2 == 0),
        F.lit(',"base_header_level":'), F.when(i % 5 == 0, F.lit("2")).otherwise(F.lit("0")), F.lit("}"))
    payload = b64_encode(utf8(F.col("content")))
    body = F.concat(F.lit('{"fetcher":{"name":"data","params":{"data":"'), payload, F.lit('"}},"converter":'),
                    conv, F.lit("}"))
    return md.select(i.alias("request_id"), body.alias("body"))


@query
def convert_options_3(spark, sf_dir):
    from quire.sources.requests import parse_requests

    out = C.convert_job(parse_requests(option_request_bodies_3(spark, sf_dir)))
    return out.select("request_id", F.col("code").cast("bigint").alias("code"),
                      F.md5("outcome.result.data").alias("data_md5"))


def marked_docs(spark, sf_dir):
    """markdown documents with a tracked change and a comment in front and the first blank turned into a tab."""
    md = X.markdown_docs(spark, sf_dir)
    c = F.concat(F.lit("<ins>ADD</ins><del>DEL</del> <!-- note --> "), F.regexp_replace("content", "^([^ \n]*) ", "$1\t"))
    return md.select("doc_id", c.alias("content"))


def option_request_bodies_4(spark, sf_dir):
    """to markdown (even ids) or html; strip_comments (id % 3 = 0); track_changes accept (id % 4 = 0) or reject
    (id % 4 = 1); e-mail references (id % 5 = 0); wrap auto at 40 columns (id % 7 = 0); preserve_tabs (id % 11 = 0)."""
    md = marked_docs(spark, sf_dir)
    i = F.col("doc_id")
    flag = lambda c: F.when(c, F.lit("true")).otherwise(F.lit("false"))
    track = F.when(i % 4 == 0, F.lit("accept")).when(i % 4 == 1, F.lit("reject")).otherwise(F.lit("all"))
    conv = F.concat(
        F.lit('{"from":"markdown","to":"'), F.when(i % 2 == 0, F.lit("markdown")).otherwise(F.lit("html")),
        F.lit('","strip_comments":'), flag(i % 3 == 0), F.lit(',"track_changes":"'), track,
        F.lit('","email_obfuscation":"'), F.when(i % 5 == 0, F.lit("references")).otherwise(F.lit("none")),
        F.lit('","wrap":"'), F.when(i % 7 == 0, F.lit("auto")).otherwise(F.lit("preserve")),
        F.lit('","columns":40,"preserve_tabs":'), flag(i % 11 == 0), F.lit("}"))
    payload = b64_encode(utf8(F.col("content")))
    body = F.concat(F.lit('{"fetcher":{"name":"data","params":{"data":"'), payload, F.lit('"}},"converter":'),
                    conv, F.lit("}"))
    return md.select(i.alias("request_id"), body.alias("body"))


@query
def convert_options_4(spark, sf_dir):
    from quire.sources.requests import parse_requests

    out = C.convert_job(parse_requests(option_request_bodies_4(spark, sf_dir)))
    return out.select("request_id", F.col("code").cast("bigint").alias("code"),
                      F.md5("outcome.result.data").alias("data_md5"))


def option_request_bodies_5(spark, sf_dir):
    """Pages as inline html requests with reference_links: to markdown (even ids) or plain; reference_location by
    id % 3 (document, block, section); fail_if_warnings when id % 4 = 3."""
    pg = X.pages_docs(spark, sf_dir)
    i = F.col("doc_id")
    flag = lambda c: F.when(c, F.lit("true")).otherwise(F.lit("false"))
    loc = F.when(i % 3 == 0, F.lit("document")).when(i % 3 == 1, F.lit("block")).otherwise(F.lit("section"))
    conv = F.concat(
        F.lit('{"from":"html","to":"'), F.when(i % 2 == 0, F.lit("markdown")).otherwise(F.lit("plain")),
        F.lit('","reference_links":true,"reference_location":"'), loc, F.lit('","fail_if_warnings":'),
        flag(i % 4 == 3), F.lit("}"))
    payload = b64_encode(utf8(F.col("content")))
    body = F.concat(F.lit('{"fetcher":{"name":"data","params":{"data":"'), payload, F.lit('"}},"converter":'),
                    conv, F.lit("}"))
    return pg.select(i.alias("request_id"), body.alias("body"))


@query
def convert_options_5(spark, sf_dir):
    from quire.sources.requests import parse_requests

    out = C.convert_job(parse_requests(option_request_bodies_5(spark, sf_dir)))
    return out.select("request_id", F.col("code").cast("bigint").alias("code"), "message",
                      F.md5("outcome.result.data").alias("data_md5"))


DOC_TEMPLATE = "$title$|$for(author)$$author$$sep$, $endfor$|$if(lang)$$lang$$else$none$endif$|$body$"


def option_request_bodies_6(spark, sf_dir):
    """Standalone markdown documents rendered through a job-level document template: variable title (even ids),
    metadata authors and lang (id % 3 = 0), title_prefix P (id % 5 = 0); to markdown (even) or html."""
    md = X.markdown_docs(spark, sf_dir)
    i = F.col("doc_id")
    var = F.when(i % 2 == 0, F.concat(F.lit('{"title":"T'), i.cast("string"), F.lit('"}'))).otherwise(F.lit("{}"))
    meta = F.when(i % 3 == 0, F.concat(F.lit('{"author":["a'), (i % 3).cast("string"), F.lit('","b"],"lang":["'),
                                       F.col("lang"), F.lit('"]}'))).otherwise(F.lit("{}"))
    conv = F.concat(
        F.lit('{"from":"markdown","to":"'), F.when(i % 2 == 0, F.lit("markdown")).otherwise(F.lit("html")),
        F.lit('","standalone":true,"variable":'), var, F.lit(',"metadata":'), meta, F.lit(',"title_prefix":"'),
        F.when(i % 5 == 0, F.lit("P")).otherwise(F.lit("")), F.lit('"}'))
    payload = b64_encode(utf8(F.col("content")))
    body = F.concat(F.lit('{"fetcher":{"name":"data","params":{"data":"'), payload, F.lit('"}},"converter":'),
                    conv, F.lit("}"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return md.join(docs, "doc_id").select(i.alias("request_id"), body.alias("body"))


@query
def convert_options_6(spark, sf_dir):
    from quire.model import JobConfig
    from quire.sources.requests import parse_requests

    out = C.convert_job(parse_requests(option_request_bodies_6(spark, sf_dir)),
                        JobConfig(document_template=DOC_TEMPLATE))
    return out.select("request_id", F.col("code").cast("bigint").alias("code"),
                      F.md5("outcome.result.data").alias("data_md5"))


def option_request_bodies_7(spark, sf_dir):
    """Documents with two inline images as markdown requests: to markdown (even) or html; extract_media into ``m``
    (id % 3 = 0) or ``media/sub/`` (id % 3 = 1); default_image_extension dat (id % 5 = 0); html pages standalone
    with a css link when id % 7 = 0."""
    from quire.plans.queries_links import media_docs

    md = media_docs(spark, sf_dir)
    i = F.col("doc_id")
    flag = lambda c: F.when(c, F.lit("true")).otherwise(F.lit("false"))
    conv = F.concat(
        F.lit('{"from":"markdown","to":"'), F.when(i % 2 == 0, F.lit("markdown")).otherwise(F.lit("html")),
        F.lit('","extract_media":"'), F.when(i % 3 == 0, F.lit("m")).when(i % 3 == 1, F.lit("media/sub/"))
        .otherwise(F.lit("")), F.lit('","default_image_extension":"'),
        F.when(i % 5 == 0, F.lit("dat")).otherwise(F.lit("")), F.lit('","standalone":'), flag(i % 7 == 0),
        F.lit(',"css":"s.css"}'))
    payload = b64_encode(utf8(F.col("content")))
    body = F.concat(F.lit('{"fetcher":{"name":"data","params":{"data":"'), payload, F.lit('"}},"converter":'),
                    conv, F.lit("}"))
    return md.select(i.alias("request_id"), body.alias("body"))


@query
def convert_options_7(spark, sf_dir):
    from quire.sources.requests import parse_requests

    out = C.convert_job(parse_requests(option_request_bodies_7(spark, sf_dir)))
    return out.select("request_id", F.col("code").cast("bigint").alias("code"),
                      F.md5("outcome.result.data").alias("data_md5"))


@query
def convert_self_contained(spark, sf_dir):
    """M1 then the job with self_contained: the corpus media are extracted (rewritten documents + resource table);
    converting the rewritten documents with self_contained (id % 3 <> 0) must give the conversion of the original
    documents, the others keep the references. to markdown (even) or html."""
    from quire.operators import media as M
    from quire.plans.queries_links import media_docs
    from quire.sources.requests import parse_requests

    rewritten, resources = M.extract_media(media_docs(spark, sf_dir), media_dir="m")
    i = F.col("doc_id")
    flag = lambda c: F.when(c, F.lit("true")).otherwise(F.lit("false"))
    conv = F.concat(F.lit('{"from":"markdown","to":"'), F.when(i % 2 == 0, F.lit("markdown")).otherwise(F.lit("html")),
                    F.lit('","self_contained":'), flag(i % 3 != 0), F.lit("}"))
    payload = b64_encode(utf8(F.col("content")))
    body = F.concat(F.lit('{"fetcher":{"name":"data","params":{"data":"'), payload, F.lit('"}},"converter":'),
                    conv, F.lit("}"))
    reqs = parse_requests(rewritten.select(i.alias("request_id"), body.alias("body")))
    out = C.convert_job(reqs, resources=resources)
    return out.select("request_id", F.col("code").cast("bigint").alias("code"),
                      F.md5("outcome.result.data").alias("data_md5"))
