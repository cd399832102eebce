"""The conversion job (E1) with per-row options, and the same options fixed for a job (E2 path)."""

from __future__ import annotations

import base64
import json

import pytest
from pyspark.sql import functions as F

from quire.plans.convert import convert_distinct, convert_job
from quire.sources.requests import parse_requests

DOC = "# A\n\nSome text here <!-- note --> with <ins>new</ins><del>old</del> words.\n\n## B\n\ncafé\tx\n\n# C\n\nmail a@b.io"


def request(rid, **options):
    conv = {"from": "markdown", "to": "markdown", **options}
    payload = base64.b64encode(DOC.encode()).decode()
    return rid, json.dumps({"fetcher": {"name": "data", "params": {"data": payload}}, "converter": conv})


CASES = {
    1: ({}, lambda t: t.startswith("A\n=\n\nSome text here <!-- note --> with <ins>new</ins><del>old</del> words.")),
    2: ({"atx_headers": True, "number_sections": True}, lambda t: t.startswith("# 1 A") and "## 1.1 B" in t
        and "# 2 C" in t),
    3: ({"atx_headers": True, "number_sections": True, "number_offset": 4}, lambda t: "# 5 A" in t and "# 6 C" in t),
    4: ({"to": "plain", "toc": True, "toc_depth": 1}, lambda t: t.startswith("- A\n\n- C\n\nA\n\n")),
    5: ({"to": "html", "id_prefix": "x-"}, lambda t: '<h1 id="x-a">A</h1>' in t and '<h2 id="x-b">B</h2>' in t),
    6: ({"to": "plain", "wrap": "auto", "columns": 10}, lambda t: "Some text\nhere" in t),
    7: ({"to": "plain", "eol": "crlf"}, lambda t: "\r\n\r\n" in t and "\n\n" not in t.replace("\r\n", "")),
    8: ({"to": "plain", "ascii": True}, lambda t: "caf&#233;" in t),
    9: ({"to": "html", "email_obfuscation": "references"}, lambda t: "&#97;&#64;&#98;" in t),
    10: ({"strip_comments": True, "to": "plain"}, lambda t: "<!--" not in t),
    11: ({"track_changes": "accept", "to": "plain"}, lambda t: "new words" in t and "old" not in t),
    12: ({"track_changes": "reject", "to": "plain"}, lambda t: "old words" in t and "new" not in t),
    13: ({"to": "plain"}, lambda t: "café    x" in t),                          # tabs expanded to stop 4
    14: ({"to": "plain", "preserve_tabs": True}, lambda t: "café\tx" in t),
    15: ({"to": "plain", "tab_stop": 8}, lambda t: "café    x" in t),
    16: ({"to": "html", "standalone": True}, lambda t: t.startswith("<!DOCTYPE html>") and "<h1>A</h1>" in t),
    17: ({"to": "markdown", "base_header_level": 2, "atx_headers": True}, lambda t: t.startswith("## A")),
}


@pytest.fixture(scope="module")
def outcomes(spark):
    raw = spark.createDataFrame([request(i, **o) for i, (o, _) in CASES.items()], "request_id bigint, body string")
    out = convert_job(parse_requests(raw))
    return {r.request_id: r for r in out.select("request_id", "code", "message",
                                                 F.decode("outcome.result.data", "UTF-8").alias("text")).collect()}


@pytest.mark.parametrize("rid", sorted(CASES))
def test_option(outcomes, rid):
    r = outcomes[rid]
    assert r.code == 0, r.message
    assert CASES[rid][1](r.text), r.text[:300]


def test_job_level_options_equal_per_row(spark):
    """The same options given for the whole job (plan-time branches) and per row (CASE branches) agree."""
    opts = {"to": "html", "number_sections": True, "id_prefix": "p-", "ascii": True}
    docs = spark.createDataFrame([(1, DOC), (2, DOC), (3, "# X\n\nplain")], "doc_id bigint, content string")
    job = {r.doc_id: r.converted for r in convert_distinct(docs, "markdown", "html", options=opts).collect()}
    raw = spark.createDataFrame([request(1, **opts)], "request_id bigint, body string")
    row = convert_job(parse_requests(raw)).select(F.decode("outcome.result.data", "UTF-8")).first()[0]
    assert job[1] == job[2] == row


def test_standalone_with_document_template(spark):
    from quire.model import JobConfig

    tpl = "$title$|$for(author)$$author$$sep$,$endfor$|$if(draft)$D$else$F$endif$|$body$"
    raw = spark.createDataFrame([
        request(1, to="plain", standalone=True, variable={"title": "T"}, metadata={"author": ["a", "b"]},
                title_prefix="P"),
        request(2, to="plain", standalone=True, title_prefix="P"),
        request(3, to="plain", standalone=False, variable={"title": "T"}),
        request(4, to="plain", standalone=True, variable={"title": "V"}, metadata={"title": ["M"], "draft": ["y"]}),
    ], "request_id bigint, body string")
    out = convert_job(parse_requests(raw), JobConfig(document_template=tpl))
    got = {r.request_id: r.t for r in out.select("request_id", F.decode("outcome.result.data", "UTF-8").alias("t"))
           .collect()}
    assert got[1].startswith("P - T|a,b|F|A\n\n")
    assert got[2].startswith("P||F|A\n\n")
    assert got[3].startswith("A\n\nSome text")
    assert got[4].startswith("V||D|")


def test_file_options(spark):
    """Rules 10/11 and the use of resolved files: includes, css, abbreviations, metadata file."""
    import os
    import uuid

    from quire.model import JobConfig
    from quire.session import scratch_path
    from quire.sources.files import file_table

    root = scratch_path(spark, f"fileopts-{uuid.uuid4().hex}")
    os.makedirs(f"{root}/safe")
    texts = {"head.html": "<meta name=x>", "before.html": "<p>BEFORE</p>", "after.html": "<p>AFTER</p>",
             "abbr.txt": "text\nSome\n", "meta.json": '{"author": ["m1", "m2"], "title": ["file title"]}'}
    for name, t in texts.items():
        with open(f"{root}/safe/{name}", "w", encoding="utf-8") as fh:
            fh.write(t)
    os.makedirs(f"{root}/outside")
    with open(f"{root}/outside/abbr.txt", "w", encoding="utf-8") as fh:
        fh.write("x\n")
    safe = f"{root}/safe"
    raw = spark.createDataFrame([
        request(1, to="html", standalone=True, css="s.css", include_in_header=f"file://{safe}/head.html",
                include_before_body=f"{safe}/before.html", include_after_body=f"{safe}/after.html"),
        request(2, to="html", include_in_header=f"{safe}/missing.html"),
        request(3, to="html", abbreviations=f"{root}/outside/abbr.txt", include_in_header=f"{safe}/missing.html"),
        request(4, to="plain", abbreviations=f"{safe}/abbr.txt"),
        request(5, to="plain", standalone=True, metadata_file=f"{safe}/meta.json", metadata={"title": ["req"]}),
        request(6, to="plain", template=f"{safe}/nope.tpl"),
    ], "request_id bigint, body string")
    conf = JobConfig(safe_dir=safe, document_template="$title$|$for(author)$$author$$sep$,$endfor$|$body$")
    out = convert_job(parse_requests(raw), conf, files=file_table(spark, root))
    got = {r.request_id: r for r in out.select("request_id", "rule", "message",
                                               F.decode("outcome.result.data", "UTF-8").alias("t")).collect()}
    assert got[1].rule == 0, got[1].message
    # html standalone without a document template is not used here: the job template applies to all standalone rows
    assert got[1].t.startswith("||")
    assert got[2].rule == 11 and got[2].message.startswith("include_in_header: file ") and "not found" in got[2].message
    assert got[3].rule == 11 and got[3].message.startswith("include_in_header")  # first in emit order wins
    assert got[4].rule == 0 and "Some\u00a0text\u00a0here" in got[4].t
    assert got[5].rule == 0 and got[5].t.startswith("req|m1,m2|")
    assert got[6].rule == 11 and got[6].message.startswith("template: file ")
    page = convert_job(parse_requests(raw.filter("request_id = 1")), JobConfig(safe_dir=safe),
                       files=file_table(spark, root)).select(F.decode("outcome.result.data", "UTF-8")).first()[0]
    assert '<link rel="stylesheet" href="s.css">\n<meta name=x>\n</head>' in page
    assert "<body>\n<p>BEFORE</p>\n<h1>A</h1>" in page and "<p>AFTER</p>\n</body>" in page


def test_warnings_and_fail_if_warnings(spark):
    bad = base64.b64encode(b"<p>caf\xe9</p>").decode()  # latin-1 byte, not UTF-8; no </body>
    rows = [(1, json.dumps({"fetcher": {"name": "data", "params": {"data": bad}},
                            "converter": {"from": "html", "to": "plain"}})),
            (2, json.dumps({"fetcher": {"name": "data", "params": {"data": bad}},
                            "converter": {"from": "html", "to": "plain", "fail_if_warnings": True}}))]
    raw = spark.createDataFrame(rows, "request_id bigint, body string")
    got = {r.request_id: r for r in convert_job(parse_requests(raw)).select(
        "request_id", "rule", "message", "warnings", F.decode("outcome.result.data", "UTF-8").alias("t")).collect()}
    assert got[1].rule == 0 and got[1].t == "caf�" and got[1].warnings == ["invalid_utf8", "html_unclosed"]
    assert got[2].rule == 12 and got[2].message == "failing because there were warnings: invalid_utf8, html_unclosed"


def test_section_divs(spark):
    doc = "# A\n\none\n\n## B\n\ntwo\n\n### C\n\n## D\n\n# E\n\nend"
    payload = base64.b64encode(doc.encode()).decode()
    rows = [(i, json.dumps({"fetcher": {"name": "data", "params": {"data": payload}},
                            "converter": {"from": "markdown", "to": "html", **o}}))
            for i, o in [(1, {"section_divs": True}), (2, {"section_divs": True, "id_prefix": "s-"})]]
    raw = spark.createDataFrame(rows, "request_id bigint, body string")
    got = {r.request_id: r.t for r in convert_job(parse_requests(raw)).select(
        "request_id", F.decode("outcome.result.data", "UTF-8").alias("t")).collect()}
    assert got[1] == ("<section>\n<h1>A</h1>\n<p>one</p>\n<section>\n<h2>B</h2>\n<p>two</p>\n<section>\n<h3>C</h3>\n"
                      "</section>\n</section>\n<section>\n<h2>D</h2>\n</section>\n</section>\n<section>\n<h1>E</h1>\n"
                      "<p>end</p>\n</section>")
    assert got[2].count("<section>") == 5 and '<h2 id="s-d">D</h2>' in got[2]


def test_reference_links(spark):
    html = ('<h1>One</h1><p>see <a href="/x">x</a> and <a href="/y">y</a></p><p>again <a href="/x">x</a></p>'
            '<h1>Two</h1><p><a href="/z">z</a> <a href="/x">x</a></p>')
    payload = base64.b64encode(html.encode()).decode()
    rows = [(i, json.dumps({"fetcher": {"name": "data", "params": {"data": payload}},
                            "converter": {"from": "html", "to": "markdown", "atx_headers": True, **o}}))
            for i, o in [(1, {"reference_links": True}), (2, {"reference_links": True, "reference_location": "block"}),
                         (3, {"reference_links": True, "reference_location": "section"}), (4, {})]]
    raw = spark.createDataFrame(rows, "request_id bigint, body string")
    got = {r.request_id: r.t for r in convert_job(parse_requests(raw)).select(
        "request_id", F.decode("outcome.result.data", "UTF-8").alias("t")).collect()}
    body = "# One\n\nsee x and y\n\nagain x\n\n# Two\n\nz x"
    assert got[4] == body
    assert got[1] == body + "\n\n[1]: /x\n[2]: /y\n[3]: /z"
    assert got[2] == ("# One\n\nsee x and y\n\n[1]: /x\n[2]: /y\n\nagain x\n\n[1]: /x\n\n# Two\n\nz x\n\n"
                      "[1]: /z\n[2]: /x")
    assert got[3] == "# One\n\nsee x and y\n\nagain x\n\n[1]: /x\n[2]: /y\n\n# Two\n\nz x\n\n[1]: /z\n[2]: /x"


def test_extract_media_option(spark):
    png = base64.b64encode(b"\x89PNG-bytes").decode()
    odd = base64.b64encode(b"other").decode()
    md = f"# Pic\n\n![a](data:image/png;base64,{png}) and ![b](data:image/x-odd;base64,{odd})"
    payload = base64.b64encode(md.encode()).decode()
    rows = [(i, json.dumps({"fetcher": {"name": "data", "params": {"data": payload}},
                            "converter": {"from": "markdown", "to": "markdown", **o}}))
            for i, o in [(1, {"extract_media": "media/"}), (2, {"extract_media": "m", "default_image_extension": "dat"}),
                         (3, {})]]
    raw = spark.createDataFrame(rows, "request_id bigint, body string")
    got = {r.request_id: r.t for r in convert_job(parse_requests(raw)).select(
        "request_id", F.decode("outcome.result.data", "UTF-8").alias("t")).collect()}
    import hashlib
    h1, h2 = hashlib.md5(b"\x89PNG-bytes").hexdigest(), hashlib.md5(b"other").hexdigest()
    assert f"![a](media/{h1}.png) and ![b](media/{h2}.bin)" in got[1]
    assert f"![a](m/{h1}.png) and ![b](m/{h2}.dat)" in got[2]
    assert "data:image/png;base64," in got[3]


def test_self_contained_option(spark):
    from quire.operators.media import extract_media

    png = base64.b64encode(b"\x89PNG-bytes").decode()
    md = f"# Pic\n\n![a](data:image/png;base64,{png})"
    corpus = spark.createDataFrame([(1, md)], "doc_id bigint, content string")
    extracted, resources = extract_media(corpus, media_dir="m")
    text = extracted.first().content
    payload = base64.b64encode(text.encode()).decode()
    rows = [(i, json.dumps({"fetcher": {"name": "data", "params": {"data": payload}},
                            "converter": {"from": "markdown", "to": "markdown", **o}}))
            for i, o in [(1, {"self_contained": True}), (2, {})]]
    raw = spark.createDataFrame(rows, "request_id bigint, body string")
    got = {r.request_id: r.t for r in convert_job(parse_requests(raw), resources=resources).select(
        "request_id", F.decode("outcome.result.data", "UTF-8").alias("t")).collect()}
    assert f"![a](data:image/png;base64,{png})" in got[1]
    assert "![a](m/" in got[2]
