"""Side files of the conversion job at their edges: metadata, bibliographies, resources, remote files, per-request templates."""

from __future__ import annotations

import base64
import json

import pytest
from pyspark.sql import functions as F

from quire.model import JobConfig
from quire.operators import blocks as B
from quire.operators import links as L
from quire.operators import metadata as D
from quire.plans.convert import convert_job
from quire.sources import files as FS
from quire.sources.requests import parse_requests

HEAD = "---\ntitle: 'A \"b\"'\nauthor:\n  - Ann\n- \"Bob C\"\nempty:\ntags: [x, 'y z',]\nnot a key\ntitle: again\ndate: 2020: may\n...\nBody\n---\n"


def test_markdown_metadata(spark):
    rows = [HEAD, "---\nno key\n---\ntext", "text\n---\na: b\n---", "---\na: b\nnever closed", "---\r\na: b\r\n---\r\nx", "---\n---\nx", "", None, "---\na:b\n---\n"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string")
    got = {r.k: r for r in df.select("k", D.markdown_metadata(F.col("t")).alias("m"), D.without_head(F.col("t")).alias("x")).collect()}
    assert [(e.key, e.value) for e in got[0].m] == [("title", ['A "b"']), ("author", ["Ann", "Bob C"]), ("empty", []), ("tags", ["x", "y z", ""]),
                                                    ("title", ["again"]), ("date", ["2020: may"])]
    assert got[0].x == "Body\n---\n"
    assert [(e.key, e.value) for e in got[4].m] == [("a", ["b"])] and got[4].x == "x"
    for k in (1, 2, 3, 5, 6, 7, 8):
        assert not got[k].m and got[k].x == rows[k]


def test_html_metadata(spark):
    page = ("<HTML><head><!-- <title>no</title> --><Title lang=en>A &lt;b&gt;\n c</tItle><meta name='Author' content=\"x&amp;y\"><META content='z' NAME=\"author\"/>"
            "<meta property='og' content='q'><meta name='k' content=''></head><body><meta name='late' content='no'><title>late</title>")
    df = spark.createDataFrame([(page,), ("<p>none",), ("",)], "t string")
    got = [[(e.key, e.value) for e in r.m] for r in df.select(D.html_metadata(F.col("t")).alias("m")).collect()]
    assert got == [[("title", ["A <b> c"]), ("author", ["x&y", "z"])], [], []]


def test_bibliography_formats(spark):
    bib = ('@book{a1,\n  title = {One  Two},\n  author={X, Y},\n year = 1999,\n journal = "J"\n}\n@misc{a1,\n title = {Second}\n}\n'
           "@article{b:2,\n  booktitle = {In B}\n}\n% @x{c, title}\n@broken{d\n")
    csl = json.dumps([{"id": "k", "title": "T", "author": [{"family": "F", "given": "G"}, {"literal": "Org"}], "issued": {"date-parts": [[2001, 2]]}, "more": 1},
                      {"id": "k", "title": "later"}, {"title": "no id"}, {"id": 7, "container-title": ""}])
    df = spark.createDataFrame([("b", bib), ("c", "﻿ " + csl), ("d", "neither"), ("e", "[not json"), ("f", "")], "source string, text string")
    got = sorted(map(tuple, L.bibliography_entries(df).collect()))
    assert got == [("b", "a1", "X, Y", "One Two", "J", "1999"), ("b", "b:2", None, None, "In B", None), ("c", "7", None, None, None, None),
                   ("c", "k", "F, G and Org", "T", None, "2001")]
    abbr = spark.createDataFrame([("a", '{"default":{"container-title":{"J":"j.","K":"k."}}}'), ("x", "{}"), ("y", "?")], "source string, text string")
    assert sorted(map(tuple, L.abbreviation_entries(abbr).collect())) == [("a", "J", "j."), ("a", "K", "k.")]


def test_citations_in_text(spark):
    m = {"a": "A.", "b": "B."}
    df = spark.createDataFrame([("[@b] x [@no] [@a][@b]", m), ("none", m), ("[@a]", {}), ("", m)], "t string, m map<string,string>")
    got = [tuple(r) for r in df.select(L.cite_in_text(F.col("t"), F.col("m")), L.reference_list(F.col("t"), F.col("m")), L.missing_citations(F.col("t"), F.col("m"))).collect()]
    assert got == [("[1] x [@no] [2][1]", ["B.", "A."], True), ("none", [], False), ("[@a]", [], True), ("", [], False)]


def uri(text):
    return "data:text/plain;base64," + base64.b64encode(text.encode()).decode()


def request(rid, content, **options):
    conv = {"from": "markdown", "to": "plain", **options}
    return rid, json.dumps({"fetcher": {"name": "data", "params": {"data": base64.b64encode(content.encode()).decode()}}, "converter": conv})


@pytest.fixture(scope="module")
def outcomes(spark):
    bib = json.dumps([{"id": "k", "title": "T", "container-title": "Long Name"}])
    files = spark.createDataFrame([("/app/bib.json", bib.encode()), ("/app/abbr.json", b'{"default":{"container-title":{"Long Name":"L. N."}}}'),
                                   ("/app/one/p.png", b""), ("/app/two/p.png", b""), ("/app/two/q.png", b""), ("/etc/p.png", b"")], FS_SCHEMA)
    crawl = spark.createDataFrame([("http://h/t", "GET", 200, "H:$body$"), ("http://h/t", "GET", 404, "no"), ("http://h/gone", "GET", 410, "x"),
                                   ("http://h/t", "POST", 200, "P")], "url string, method string, status int, body string")
    reqs = [
        request(1, "x [@k] [@m]", bibliography="/app/bib.json"), request(1, "x [@k] other", bibliography="/app/bib.json"),
        request(2, "[@k]", bibliography=uri(bib), citation_abbreviations="file:///app/abbr.json"), request(3, "[@k]"),
        request(4, "[@k]", bibliography="/app/none.json"), request(5, "[@m]", bibliography="/app/bib.json", fail_if_warnings=True),
        request(6, "![a](p.png) ![b](q.png) ![c](r.png) ![d](/p.png)", resource_path="/etc:/app/one:/app/two/"),
        request(7, "![a](p.png)", resource_path="/app/two:/app/one"), request(8, "![a](../../etc/p.png)", resource_path="/app/one"),
        request(9, "b", template="http://h/t"), request(10, "b", template="http://h/gone"), request(11, "b", template="HTTP://h/absent"),
        request(12, "b", template=uri("$if(x)$")), request(13, "---\nx: y\n---\nb", template=uri("$x$/$body$")),
        request(14, "---\nx: y\n---\nb", template=uri("$x$/$body$"), variable={"x": "v"}), request(15, "---\nx: y\n---\nb"),
        request(16, "b [@k]", bibliography="/app/bib.json", template=uri("<$body$>"), to="html"), request(17, "b", template="ftp://h/t"),
    ]
    raw = spark.createDataFrame(reqs, "request_id bigint, body string")
    out = convert_job(parse_requests(raw), JobConfig(), {"http": {"crawl": crawl}}, files=files)
    got = {}
    for r in out.select("request_id", "rule", "message", "warnings", F.decode("outcome.result.data", "UTF-8").alias("text")).collect():
        got.setdefault(r.request_id, []).append((r.text, r.rule, r.message, r.warnings))
    return got


FS_SCHEMA = "f_path string, f_bytes binary"


def test_citations_in_the_job(outcomes):
    assert sorted(o[0] for o in outcomes[1]) == ["x [1] [@m]\n\n[1] T. Long Name.", "x [1] other\n\n[1] T. Long Name."]
    assert sorted(o[3] for o in outcomes[1]) == [[], ["unresolved_citation"]]
    assert outcomes[2][0][0] == "[1]\n\n[1] T. L. N." and outcomes[3][0][0] == "[@k]"
    assert outcomes[4][0][1:3] == (10, "bibliography: file /app/none.json not found")
    assert outcomes[5][0][1:3] == (12, "failing because there were warnings: unresolved_citation")


def test_resources_in_the_job(outcomes):
    assert outcomes[6][0][0] == "![a](/app/one/p.png) ![b](/app/two/q.png) ![c](r.png) ![d](/p.png)"
    assert outcomes[6][0][3] == ["unresolved_resource"] and outcomes[7][0][0] == "![a](/app/two/p.png)"
    assert outcomes[8][0][0] == "![a](../../etc/p.png)"  # outside of the safe folder


def test_templates_and_remote_files_in_the_job(outcomes):
    assert outcomes[9][0][0] == "H:b"
    assert outcomes[10][0][1:3] == (11, "template: [fetcher-http]: fetch url by GET failure <http://h/gone>, status code is 410")
    assert outcomes[11][0][1:3] == (11, "template: fetch url by GET failure <HTTP://h/absent>, no snapshot")
    assert outcomes[12][0][1:3] == (12, "template: $if(x)$ is not closed")
    assert [outcomes[k][0][0] for k in (13, 14, 15)] == ["y/b", "v/b", "b"]
    assert outcomes[16][0][0] == "<<p>b [1]</p>\n<p>[1] T. Long Name.</p>>"
    assert outcomes[17][0][1:3] == (11, "template: unsupported scheme")


def test_block_marks_cannot_be_forged(spark):
    df = spark.createDataFrame([("<p>a &#1;h1&#2;fake &#x01; b</p><p>c\u0001h1\u0002d</p>", "x\u0001y\n\n# h\u0002")], "h string, m string")
    r = df.select(B.html_block_array(F.col("h")).alias("h"), B.markdown_block_array(F.col("m")).alias("m")).first()
    assert [(b.kind, b.text) for b in r.h] == [("para", "a �h1�fake � b"), ("para", "c�h1�d")]
    assert [(b.kind, b.text) for b in r.m] == [("para", "x�y"), ("heading", "h�")]


def test_distinct_by_content_and_options(spark):
    from quire.plans.convert import convert_distinct, converter_struct, options_fingerprint

    conv = converter_struct(**{"from": "markdown", "to": "html"})
    m = lambda *kv: F.create_map(*[F.lit(x) for x in kv])
    rows = [conv, conv.withField("ascii", F.lit(False)).withField("toc_depth", F.lit(0)), conv.withField("variable", m("a", "1", "b", "2")),
            conv.withField("variable", m("b", "2", "a", "1")), conv.withField("variable", m("a", "1")), conv.withField("to", F.lit("plain"))]
    df = spark.range(1).select(*[options_fingerprint(c).alias(f"f{k}") for k, c in enumerate(rows)]).first()
    assert df[0] == df[1] and df[2] == df[3] and len(set(df)) == 4
    docs = spark.range(6).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 5, "# A").alias("content")).withColumn("conv", conv.withField(
        "to", F.when(F.col("doc_id") % 2 == 0, "html").otherwise("plain")).withField("ascii", F.when(F.col("doc_id") == 2, False)))
    got = {r.doc_id: r.converted for r in convert_distinct(docs, converter="conv").collect()}
    assert got == {0: "<h1>A</h1>", 1: "A", 2: "<h1>A</h1>", 3: "A", 4: "<h1>A</h1>", 5: got[5]}
    one = {r.doc_id: r.converted for r in convert_distinct(docs.where("doc_id < 2"), converter="conv").collect()}
    assert one == {0: "<h1>A</h1>", 1: "A"}


def test_resource_paths_are_not_broadcast(spark, tmp_path):
    """References times folders grow with the requests: however small they look to Spark, they are no task's and no driver's."""
    from quire.operators.media import resource_paths

    refs = spark.createDataFrame([(k, k, f"img/{k}.png", "/app/a:/app/b") for k in range(4)], "request_id bigint, refs_hash bigint, ref string, resource_path string")
    files = spark.createDataFrame([("/app/b/img/1.png",), ("/app/a/img/2.png",), ("/app/b/img/2.png",)], "f_path string")
    for name, df in (("refs", refs), ("files", files)):  # tables of known size, as the job has them
        df.write.parquet(str(tmp_path / name))
    refs, files = (spark.read.parquet(str(tmp_path / name)) for name in ("refs", "files"))
    found = resource_paths(refs, files, "/app")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.select("request_id", F.map_values("paths")).collect())) == [(1, ["/app/b/img/1.png"]), (2, ["/app/a/img/2.png"])]
