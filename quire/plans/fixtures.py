"""Derived inputs built from the test tables inside a query (nothing is written to the test data).

Every derivation is a narrow projection or a join of the given tables, so its size grows with them. The same rules
are repeated in the oracle SQL (``quire.plans.oracle``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.codecs import b64_encode, utf8
from quire.session import table


def pages_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as docs(doc_id, content) of HTML."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("content"))


def documents_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))


def markdown_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents marked up as markdown: a title heading, lines starting with E become items, lines starting with A
    start a new paragraph, lines starting with T become level-2 headings and lines starting with O level-3 ones."""
    t = F.col("text")
    md = F.regexp_replace(t, r"(?m)^E", "- E")
    md = F.regexp_replace(md, r"(?m)^A", "\nA")
    md = F.regexp_replace(md, r"(?m)^T", "## T")
    md = F.regexp_replace(md, r"(?m)^O", "### O")
    md = F.concat(F.lit("# Document "), F.col("doc_id").cast("string"), F.lit("\n\n"), md)
    return table(spark, sf_dir, "documents").select("doc_id", md.alias("content"))


def bad_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """base64 payloads of documents with defects: % 19 -> '', % 17 -> '$' in front, % 13 -> one padding '=' less."""
    p, i = F.col("p__"), F.col("doc_id")
    bad = (
        F.when(i % 19 == 0, F.lit(""))
        .when(i % 17 == 0, F.concat(F.lit("$"), p))
        .when((i % 13 == 0) & p.endswith("="), F.expr("substring(p__, 1, length(p__) - 1)"))
        .otherwise(p)
    )
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", "source", b64_encode(utf8(F.col("text"))).alias("p__"))
        .select("doc_id", "source", bad.alias("payload"))
    )


def _case(key, pairs, default):
    out = None
    for k, v in pairs:
        cond = key == k
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out.otherwise(default)


def rows_of(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Rows of a table: what its ids are drawn from (Parquet footers only)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").count()


def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversion requests derived from documents (one per document), as raw JSON bodies ``(request_id, body)``.

    fetcher name by id % 10: 0 '', 1 'ftp', 2-3 'http', else 'data'; http requests point at the page with
    page_id = id % (6/5 of the number of pages) (so every page is asked for and some requests miss the crawl); data requests carry the defective payloads of ``bad_payloads``;
    fetcher missing if id % 23 = 0, converter missing if id % 29 = 0; data_dir by id % 7; template by id % 4;
    ``to`` by id % 3 (pdf, markdown, html); a few more options vary with the id. Bodies: id % 41 -> '',
    id % 37 -> 'null', id % 31 -> cut by one character."""
    i = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("pk"), "url")
    ids = rows_of(spark, sf_dir, "pages") * 6 // 5
    d = docs.join(pages, (i % ids) == F.col("pk"), "left")
    name = _case(i % 10, [(0, F.lit("")), (1, F.lit("ftp")), (2, F.lit("http")), (3, F.lit("http"))], F.lit("data"))
    d = d.select("doc_id", "lang", "source", "url", b64_encode(utf8(F.col("text"))).alias("p__"))
    p = F.col("p__")
    payload = (
        F.when(i % 19 == 0, F.lit(""))
        .when(i % 17 == 0, F.concat(F.lit("$"), p))
        .when((i % 13 == 0) & p.endswith("="), F.expr("substring(p__, 1, length(p__) - 1)"))
        .otherwise(p)
    )
    url = F.coalesce(F.col("url"), F.concat(F.lit("http://missing.example/"), (i % ids).cast("string")))
    params = F.when(name == "http", F.concat(F.lit('{"url":"'), url, F.lit('","method":"get"}'))).otherwise(
        F.concat(F.lit('{"data":"'), payload, F.lit('"}')))
    fetcher = F.concat(F.lit('{"name":"'), name, F.lit('","params":'), params, F.lit("}"))
    to = _case(i % 3, [(0, F.lit("pdf")), (1, F.lit("markdown"))], F.lit("html"))
    frm = F.when(name == "http", F.lit("html")).otherwise(F.lit("plain"))
    dd = _case(i % 7, [(0, F.lit("/app/x")), (1, F.lit("/app2")), (2, F.lit("/app/../etc"))], F.lit(None))
    dd_part = F.when(dd.isNull(), F.lit("")).otherwise(F.concat(F.lit(',"data_dir":"'), dd, F.lit('"')))
    conv = F.concat(
        F.lit('{"from":"'), frm, F.lit('","to":"'), to, F.lit('"'), dd_part,
        F.lit(',"standalone":'), (i % 2 == 0).cast("string"),
        F.lit(',"toc":'), (i % 3 == 0).cast("string"),
        F.lit(',"toc_depth":'), (i % 5).cast("string"),
        F.lit(',"number_offset":'), (i % 7 - 3).cast("string"),
        F.lit(',"filter":"'), F.when(i % 5 == 0, F.lit("f.py")).otherwise(F.lit("")), F.lit('"'),
        F.lit(',"variable":{"source":"'), F.col("source"), F.lit('","lang":"'), F.col("lang"), F.lit('"}'),
        F.lit(',"metadata":{"tags":["'), F.col("lang"), F.lit('","'), F.col("source"), F.lit('"]}}'),
    )
    tmpl = _case(i % 4, [(0, F.lit("")), (1, F.lit("binary")), (2, F.lit("render-html"))], F.lit("nope"))
    full = F.concat(
        F.lit("{"),
        F.when(i % 23 == 0, F.lit("")).otherwise(F.concat(F.lit('"fetcher":'), fetcher, F.lit(","))),
        F.when(i % 29 == 0, F.lit("")).otherwise(F.concat(F.lit('"converter":'), conv, F.lit(","))),
        F.lit('"template":"'), tmpl, F.lit('"}'),
    )
    j = F.col("request_id")
    body = (
        F.when(j % 41 == 0, F.lit(""))
        .when(j % 37 == 0, F.lit("null"))
        .when(j % 31 == 0, F.expr("substring(f__, 1, length(f__) - 1)"))
        .otherwise(F.col("f__"))
    )
    return d.select(i.alias("request_id"), full.alias("f__")).select("request_id", body.alias("body"))
