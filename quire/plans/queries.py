"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator of the inventory.

Each reads whole test tables (or data Spark derives from them) and aliases every computed column so the names match
the oracle SQL in ``quire.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import jobs
from quire.functions.codecs import b64_encode, md5_text, message_col, utf8
from quire.operators import blocks as B
from quire.operators import render as R
from quire.operators.results import envelope, render_default
from quire.plans import fixtures as X
from quire.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- step 1: blocks, plain rendering, envelope, codec jobs -------------------------------------------------------


@query
def html_blocks(spark, sf_dir):
    return B.html_blocks(X.pages_docs(spark, sf_dir))


@query
def strip_empty(spark, sf_dir):
    return B.strip_empty_paragraphs(B.html_blocks(X.pages_docs(spark, sf_dir)))


@query
def html_to_plain(spark, sf_dir):
    """Block table path: explode, drop empty paragraphs, regroup per document, render."""
    bl = B.strip_empty_paragraphs(B.html_blocks(X.pages_docs(spark, sf_dir)))
    return R.assemble(bl).select("doc_id", R.render_plain(F.col("blocks")).alias("content"))


@query
def convert_pages(spark, sf_dir):
    """Flagship, in-row path of the minimal slice over a crawl: every crawled page is converted to plain text
    (html -> blocks -> drop empty -> plain) and wrapped in the default JSON response; a page the crawl answered with
    a status other than 200 (every tenth page here) becomes a 400 outcome with the fetch message. No shuffle."""
    pages = table(spark, sf_dir, "pages")
    status = F.when(F.col("page_id") % 10 == 0, F.lit(404)).otherwise(F.lit(200))
    error = F.when(F.col("status") != 200, message_col("fetch_failure", method="GET", url=F.col("url"),
                                                       status=F.col("status").cast("string")))
    content = R.render_plain(B.drop_empty_paras(B.html_block_array(F.col("html"))))
    out = pages.select(F.col("page_id").alias("doc_id"), "url", "html", status.alias("status")).select(
        "doc_id", error.alias("error"), "html").select(
        "doc_id", "error", F.when(F.col("error").isNull(), content).alias("content"))
    o = envelope(F.col("error"), F.encode("content", "UTF-8"))
    return out.select("doc_id", o.alias("o"), "content").select(
        "doc_id", F.col("o.code").cast("bigint").alias("code"), F.col("o.message").alias("message"),
        F.coalesce(F.length("content"), F.lit(0)).cast("bigint").alias("n_chars"),
        md5_text(render_default(F.col("o"))).alias("response_md5"),
    )


@query
def text_blocks(spark, sf_dir):
    return B.text_blocks(X.documents_docs(spark, sf_dir), "plain")


@query
def markdown_blocks(spark, sf_dir):
    return B.text_blocks(X.markdown_docs(spark, sf_dir), "markdown")


@query
def encode_corpus(spark, sf_dir):
    return jobs.encode_corpus(table(spark, sf_dir, "documents"))


@query
def decode_corpus(spark, sf_dir):
    d = jobs.decode_corpus(X.bad_payloads(spark, sf_dir))
    return d.select("doc_id", "source", "ok", F.md5("data").alias("data_md5"))


@query
def decode_summary(spark, sf_dir):
    return jobs.decode_summary(jobs.decode_corpus(X.bad_payloads(spark, sf_dir)))


@query
def export_json(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return jobs.export_json(ev, "event_id", "user_id", "event_type", "props")


@query
def duplicate_groups(spark, sf_dir):
    return jobs.duplicate_groups(table(spark, sf_dir, "documents"))


@query
def byte_profile(spark, sf_dir):
    return jobs.byte_profile(table(spark, sf_dir, "documents"), "text", "lang", "source")


@query
def escape_corpus(spark, sf_dir):
    e = jobs.escape_corpus(X.pages_docs(spark, sf_dir), "content")
    return e.select("doc_id", md5_text(F.col("escaped")).alias("escaped_md5"), "n_replaced")


@query
def entity_inventory(spark, sf_dir):
    return jobs.entity_inventory(X.pages_docs(spark, sf_dir), "content")


@query
def unescape_corpus(spark, sf_dir):
    u = jobs.unescape_corpus(X.pages_docs(spark, sf_dir), "content")
    return u.select("doc_id", md5_text(F.col("decoded")).alias("decoded_md5"))


# --- step 2: requests, validation, fetch, options ----------------------------------------------------------------

from quire.model import JobConfig  # noqa: E402
from quire.operators import options as O  # noqa: E402
from quire.operators import validate as V  # noqa: E402
from quire.sources import fetch as S  # noqa: E402
from quire.sources.requests import parse_requests  # noqa: E402

PREFIX_CONF = JobConfig(safe_dir_mode="prefix")


def _requests(spark, sf_dir):
    return parse_requests(X.request_bodies(spark, sf_dir))


def _validated(spark, sf_dir, conf=JobConfig()):
    return V.validate_requests(_requests(spark, sf_dir), conf)


def _crawl(spark, sf_dir):
    return S.crawl_from_pages(table(spark, sf_dir, "pages"))


def _fetched(spark, sf_dir, conf=JobConfig()):
    return S.dispatch_fetch(_validated(spark, sf_dir, conf), conf, {"http": {"crawl": _crawl(spark, sf_dir), "unique": True}})


@query
def read_requests(spark, sf_dir):
    r = _requests(spark, sf_dir)
    c = F.col("converter")
    return r.select(
        "request_id", "bad_json", F.col("fetcher").isNotNull().alias("has_fetcher"),
        c.isNotNull().alias("has_converter"), F.col("fetcher.name").alias("fetcher_name"),
        c["from"].alias("src_format"), c["to"].alias("dst_format"), c["data_dir"].alias("data_dir"),
        c["toc_depth"].cast("bigint").alias("toc_depth"), "template",
    )


def _rule_view(v):
    return v.select(
        "request_id", F.coalesce("rule", F.lit(0)).cast("bigint").alias("rule"),
        F.when(F.col("rule").isNull(), 0).otherwise(400).cast("bigint").alias("code"),
        F.coalesce("message", F.lit("")).alias("message"),
    )


@query
def validate_requests(spark, sf_dir):
    return _rule_view(_validated(spark, sf_dir))


@query
def validate_requests_prefix(spark, sf_dir):
    return _rule_view(_validated(spark, sf_dir, PREFIX_CONF))


@query
def fetch_inline(spark, sf_dir):
    v = _validated(spark, sf_dir).filter(F.col("rule").isNull() & (F.col("driver") == "data"))
    f = S.fetch_inline(v)
    return f.select("request_id", F.col("data").isNotNull().alias("ok"), F.md5("data").alias("data_md5"),
                    F.octet_length("data").cast("bigint").alias("n_bytes"))


@query
def fetch_snapshot(spark, sf_dir):
    v = _validated(spark, sf_dir).filter(F.col("rule").isNull() & (F.col("driver") == "http"))
    f = S.fetch_snapshot(v, {"crawl": _crawl(spark, sf_dir)})
    return f.select("request_id", "fetch_error", F.md5("data").alias("data_md5"))


@query
def dispatch_fetch(spark, sf_dir):
    f = _fetched(spark, sf_dir)
    return f.select(
        "request_id", "driver", F.coalesce("rule", F.when(F.col("fetch_error").isNotNull(), 9)).cast("bigint")
        .alias("rule"), F.coalesce("message", "fetch_error").alias("error"), F.md5("data").alias("data_md5"),
    )


def _paths(spark, sf_dir):
    i = F.col("doc_id")
    seg = F.lower(F.col("lang"))
    cases = [
        F.lit("/app"), F.concat(F.lit("/app/"), seg), F.concat(F.lit("/app/x/../"), seg), F.lit("/app2"),
        F.concat(F.lit("/app/../"), seg), F.concat(F.lit("/app/./"), seg, F.lit("//b")), F.concat(F.lit("/etc/app/"), seg),
        F.concat(F.lit("/app/x/../../app/"), seg),
    ]
    path = X._case(i % 8, list(enumerate(cases)), F.lit(None))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))


@query
def safe_path_prefix(spark, sf_dir):
    p = _paths(spark, sf_dir)
    return p.select("doc_id", "path", V.within_safe_dir(F.col("path"), "/app", "prefix").alias("safe"))


@query
def safe_path_strict(spark, sf_dir):
    p = _paths(spark, sf_dir)
    return p.select("doc_id", "path", V.normalize_path(F.col("path")).alias("normalized"),
                    V.within_safe_dir(F.col("path"), "/app", "strict").alias("safe"))


@query
def gate_options(spark, sf_dir):
    conf = JobConfig(enable_filter=True, enable_lua_filter=False)
    r = _requests(spark, sf_dir).filter(F.col("converter").isNotNull())
    f, lf = V.gate_options(F.col("converter"), conf)
    return r.select("request_id", F.col("converter.filter").alias("filter_in"), f.alias("filter_kept"),
                    lf.alias("lua_filter_kept"))


@query
def options_long(spark, sf_dir):
    return O.options_long(_requests(spark, sf_dir))


@query
def option_usage(spark, sf_dir):
    return O.option_usage(O.options_long(_requests(spark, sf_dir)))


@query
def key_values(spark, sf_dir):
    return O.key_values(_requests(spark, sf_dir))


@query
def replace_map(spark, sf_dir):
    pg = table(spark, sf_dir, "pages")
    m = F.create_map(
        F.lit("example"), F.concat(F.lit("sample-"), (F.col("page_id") % 3).cast("string")),
        F.lit("http"), F.lit("https"), F.lit("<br>"), F.lit(" "), F.lit("ht"), F.lit("HT"), F.lit(""), F.lit("x"),
    )
    return pg.select(F.col("page_id").alias("doc_id"), md5_text(S.replace_map(F.col("html"), m)).alias("content_md5"))


@query
def resource_name(spark, sf_dir):
    pg = table(spark, sf_dir, "pages")
    ct = X._case(F.col("page_id") % 3, [(0, F.lit("text/html")), (1, F.lit("text/plain"))], F.lit("application/x-y"))
    return pg.select(F.col("page_id").alias("doc_id"), O.resource_name(F.col("url"), ct).alias("name"))


def data_uri_refs(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    payload = b64_encode(utf8(F.col("text")))
    ref = F.when(F.col("item_id") % 5 == 0, F.concat(F.lit("data:text/plain,"), payload)).otherwise(
        F.concat(F.lit("data:text/plain;base64,"), payload))
    return b.select("item_id", ref.alias("ref"))


@query
def decode_data_uris(spark, sf_dir):
    d = S.decode_data_uris(data_uri_refs(spark, sf_dir))
    return d.select("item_id", "matched", "content_type", F.md5("data").alias("data_md5"), "error")


@query
def option_value_usage(spark, sf_dir):
    return O.option_value_usage(O.options_long(_requests(spark, sf_dir)))


@query
def export_json_maps(spark, sf_dir):
    """F3 with a map column: the event's props parsed into a map, written back with sorted keys."""
    ev = table(spark, sf_dir, "events").select(
        "event_id", "event_type",
        F.map_concat(F.from_json("props", "map<string,string>"),
                     F.create_map(F.lit("a_type"), F.col("event_type"))).alias("props"))
    return jobs.export_json(ev, "event_id", "props")
