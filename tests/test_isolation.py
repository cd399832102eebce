"""One bad request must not fail or change another, and no input is silently lost."""

from __future__ import annotations

import base64
import json

import pytest
from pyspark.sql import functions as F

from quire.model import JobConfig
from quire.operators import blocks as B
from quire.operators import media as M
from quire.operators import normalize as N
from quire.plans.convert import abbreviation_regex, convert_distinct, convert_job
from quire.sources.fetch import fetch_snapshot, one_per_url
from quire.sources.requests import parse_requests, read_requests


def body(text="# A\n\n[x](u)", frm="markdown", to="plain", rid=None, **options):
    out = {"fetcher": {"name": "data", "params": json.dumps({"data": base64.b64encode(text.encode()).decode()})},
           "converter": {"from": frm, "to": to} | options}
    return json.dumps(out | ({} if rid is None else {"request_id": rid}))


def convert(spark, bodies, **kw):
    raw = spark.createDataFrame(list(enumerate(bodies)), "request_id bigint, body string")
    return {r.request_id: r for r in convert_job(parse_requests(raw), **kw).collect()}


HTML = "<h1>A</h1><p><a href='u'>x</a></p><h1>B</h1><p><a href='v'>y</a></p>"


def test_integers_out_of_range(spark):
    big = 2147483647
    got = convert(spark, [body(), body(base_header_level=big), body(number_sections=True, number_offset=big),
                          body("a\tb", tab_stop=big), body("a\tb", tab_stop=4), body(columns=big, wrap="auto"), body(toc_depth=big, toc=True)])
    assert [got[k].code for k in range(7)] == [0, 400, 400, 400, 0, 400, 400]
    assert all(got[k].rule == 12 for k in (1, 2, 3, 5, 6)) and "tab_stop" in got[3].message


def test_toc_with_section_notes(spark):
    got = convert(spark, [body(HTML, "html", "markdown", toc=True, reference_links=True, reference_location="section"),
                          body(HTML, "html", "markdown", toc=True, reference_links=True, reference_location="block")])
    assert got[0].code == 0 and got[1].code == 0
    text = bytes(got[0].outcome.result.data).decode()
    assert text.index("[1]: u") < text.rindex("B") < text.index("[1]: v")


def test_text_ids_and_repeated_lines(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text("\n".join([body(rid="abc-1"), body(rid=7), body(), body(), "{"]))
    got = read_requests(spark, str(path))
    assert got.count() == 5 and got.where("request_id is null").count() == 0 and got.where("request_id = 7").count() == 1
    out = convert_job(got).collect()
    assert sorted(r.code for r in out) == [0, 0, 0, 0, 400]


def test_repeated_ids_with_file_options(spark):
    files = spark.createDataFrame([("/app/a.html", bytearray(b"<b>A</b>")), ("/app/b.html", bytearray(b"<b>B</b>"))],
                                  "f_path string, f_bytes binary")
    one, two = (body(to="html", standalone=True, include_in_header=f"/app/{x}.html") for x in "ab")
    raw = spark.createDataFrame([(1, one), (1, one), (1, two), (2, body())], "request_id bigint, body string")
    out = convert_job(parse_requests(raw), files=files).collect()
    assert sorted(r.code for r in out) == [0, 0, 0, 0]
    texts = [bytes(r.outcome.result.data).decode() for r in out]
    assert sum("<b>A</b>" in t for t in texts) == 2 and sum("<b>B</b>" in t for t in texts) == 1


def test_file_options_without_a_file_table(spark):
    got = convert(spark, [body(to="html", standalone=True, include_in_header="/etc/passwd"), body(to="html")])
    assert (got[0].code, got[0].rule in (10, 11)) == (400, True) and "/etc/passwd" in got[0].message and got[1].code == 0


def test_abbreviation_files_are_quoted(spark):
    df = spark.createDataFrame([("Dr. \\E x. a(b c", "Dr.\n\\E\n[x\na(b\n$1")], "t string, f string")
    assert df.select(F.regexp_replace("t", abbreviation_regex(F.col("f")), F.lit("$1" + N.NBSP))).first()[0] == "Dr. \\E x. a(b c"
    many = ["Prof. Dr.", "Prof."] + [f"w{k}." for k in range(1001)]
    df = spark.createDataFrame([("Prof. Dr. X w1000. y",)], "t string")
    assert df.select(N.abbreviations(F.col("t"), many)).first()[0] == "Prof. Dr. X w1000. y"


def test_media_that_does_not_decode(spark):
    uri = "data:image/png;base64,abc"
    docs = spark.createDataFrame([(1, f"a {uri} z"), (2, "data:image/png;base64,aGk= data:text/plain;base64,aGk="), (3, None)],
                                 "doc_id int, content string")
    out, res = M.extract_media(docs)
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].content == f"a {uri} z" and got[1].n_media == 0 and got[3].content is None
    assert sorted((r.content_type, r.path[-4:]) for r in res.collect()) == [("image/png", ".png"), ("text/plain", ".txt")]
    back = {r.doc_id: r.content for r in M.self_contained(out.select("doc_id", "content"), res).collect()}
    assert back == {r.doc_id: r.content for r in docs.collect()}


def test_null_and_repeated_content(spark):
    docs = spark.createDataFrame([(1, "# A"), (2, None), (3, "# A"), (4, "b"), (5, None), (6, "# A")], "doc_id int, content string")
    got = {r.doc_id: r.converted for r in convert_distinct(docs, "markdown", "html").collect()}
    assert len(got) == 6 and got[1] == got[3] == got[6] == "<h1>A</h1>" and got[4] == "<p>b</p>"


@pytest.mark.parametrize("html,want", [
    ("lead <b>x</b><p>p</p>", [(0, "para", "lead x"), (1, "para", "p")]), ("only<br>text", [(0, "para", "only text")]),
    ("<pre>a</pre><blockquote>q</blockquote><section>s</section><table><th>h</th></table>",
     [(1, "para", "a"), (2, "para", "q"), (3, "para", "s"), (4, "para", ""), (5, "para", "h")]), ("li", [(0, "para", "li")]), ("<p>x", [(1, "para", "x")])])
def test_lead_text(spark, html, want):
    df = spark.createDataFrame([(html,)], "c string").select(F.explode(B.html_block_array(F.col("c"))).alias("b")).select("b.*")
    assert [(r.block_no, r.kind, r.text) for r in df.collect()] == want


def test_one_crawl_row_per_url(spark):
    crawl = spark.createDataFrame([("u", "GET", 404, "no"), ("u", "GET", 200, "b"), ("u", "GET", 200, "a"), ("v", "GET", 200, "v"),
                                   ("w", "GET", 200, "w"), ("w", "GET", 200, "w")], "url string, method string, status int, body string")
    assert sorted((r.url, r.status, r.body) for r in one_per_url(crawl).collect()) == [("u", 200, "a"), ("v", 200, "v"), ("w", 200, "w")]
    rows = spark.createDataFrame([(1, ("http", '{"url": "u"}'))], "request_id int, fetcher struct<name:string,params:string>")
    out = fetch_snapshot(rows, {"crawl": crawl}).collect()
    assert [bytes(r.data) for r in out] == [b"a"]


def test_custom_templates_and_filters_in_the_job(spark):
    from quire.plans import registry as X

    X.register_template("upper-json", lambda o, to: F.upper(F.concat(to, F.lit(":"), o["message"], F.lit(":"), o["code"].cast("string"))))
    X.register_filter("no-items", lambda b: F.filter(b, lambda x: x["kind"] != "item"))
    raw = [json.dumps(json.loads(body("# A\n- i", to="plain", filter="no-items")) | {"template": "upper-json"}), body("# A\n- i", filter="no-items")]
    on = convert(spark, raw, conf=JobConfig(enable_filter=True))
    off = convert(spark, raw)
    assert bytes(on[0].response) == b"PLAIN::0" and on[0].template_used == "upper-json"
    assert bytes(on[1].outcome.result.data) == b"A" and bytes(off[1].outcome.result.data) == b"A\n\n- i"


def test_data_uri_file_options(spark):
    files = spark.createDataFrame([], "f_path string, f_bytes binary")
    got = convert(spark, [body(to="html", standalone=True, include_in_header="data:text/html;base64,PGI+"),
                          body(to="html", standalone=True, include_in_header="data:text/html;base64,P!")], files=files)
    assert got[0].code == 0 and b"<b>" in bytes(got[0].outcome.result.data) and got[1].code == 400


def test_binary_and_embed_success(spark):
    from quire.operators.results import envelope, render_binary, render_embed

    df = spark.createDataFrame([(None, b"%PDF", "pdf"), (None, b"x", "html"), ("a<b", None, "pdf")], "e string, d binary, t string")
    o = envelope(F.col("e"), F.col("d"))
    got = df.select(render_binary(o, F.col("t")).alias("b"), render_embed(o, F.col("t")).alias("h")).collect()
    assert [(r.b.status, r.b.content_type, bytes(r.b.body)) for r in got] == [
        (200, "application/pdf", b"%PDF"), (200, None, b"x"), (400, None, b"a<b")]
    assert 'src="data:application/pdf;base64,JVBERg=="' in got[0].h and "embed" not in got[1].h and "a&lt;b" in got[2].h
