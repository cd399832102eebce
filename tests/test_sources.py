"""Literal cases for sources and corpus operators: side files, data URIs, resource names, media round trip,
citations, ordered concatenation across ranges, dedup conversion."""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import functions as F

from quire.operators import links as L
from quire.operators import media as M
from quire.operators import outline as O
from quire.operators.options import resource_name
from quire.plans.convert import convert_distinct
from quire.session import scratch_path
from quire.sources import fetch as S
from quire.sources import files as FS
from tests.conftest import rows


def test_fetch_files_schemes_and_safety(spark):
    root = scratch_path(spark, f"files-{uuid.uuid4().hex}")
    os.makedirs(f"{root}/safe/sub")
    with open(f"{root}/safe/sub/a.txt", "wb") as fh:
        fh.write(b"alpha")
    with open(f"{root}/other.txt", "wb") as fh:
        fh.write(b"beta")
    refs = spark.createDataFrame([
        (1, f"file://{root}/safe/sub/a.txt"), (2, f"{root}/safe/sub/../sub/a.txt"), (3, f"file:{root}/safe/sub/a.txt"),
        (4, f"{root}/other.txt"), (5, f"{root}/safe/../other.txt"), (6, "http://example.org/a.txt"),
        (7, f"{root}/safe/missing.txt")], "id int, ref string")
    got = {r.id: r for r in FS.fetch_files(refs, FS.file_table(spark, root), f"{root}/safe").collect()}
    assert all(bytes(got[i].data) == b"alpha" for i in (1, 2, 3))
    assert got[4].file_error.endswith("is not in safe dir") and got[5].file_error.endswith("is not in safe dir")
    assert got[6].file_error == "unsupported scheme"
    assert got[7].file_error.endswith("not found")


def test_data_uris(spark):
    df = spark.createDataFrame([("data:text/plain;base64,aGk=",), ("data:text/plain,aGk=",), ("data:a/b;x,$$",),
                                ("data:;base64,aGk=",)], "ref string")
    got = rows(S.decode_data_uris(df), "matched", "content_type", "data", "error")
    assert got[0][:2] == (True, "text/plain") and bytes(got[0][2]) == b"hi" and got[0][3] is None
    assert got[1] == (False, None, None, "not a data uri")
    assert got[2] == (True, "a/b", None, "bad base64 payload")
    assert got[3][0] is True and got[3][1] == ""


def test_resource_names(spark):
    df = spark.createDataFrame([("http://h/a/b.png?x=1", "image/png"), ("http://h/a/page", "text/html"),
                                ("http://h", "text/html"), ("http://h/x", "application/x-y")], "url string, ct string")
    got = [r[0] for r in df.select(resource_name(F.col("url"), F.col("ct"))).collect()]
    assert got == ["b.png", "page.html", hashlib.md5(b"http://h").hexdigest() + ".html", "x"]


def test_media_round_trip(spark):
    uri_a = "data:image/png;base64,iVBORw0K"
    docs = spark.createDataFrame([(1, f"see {uri_a} and {uri_a}"), (2, f"also {uri_a}"), (3, "none")],
                                 "doc_id bigint, content string")
    out, res = M.extract_media(docs, media_dir="m")
    h = hashlib.md5(bytes.fromhex("89504e470d0a")).hexdigest()
    by = {r.doc_id: r for r in out.collect()}
    assert by[1].content == f"see m/{h}.png and m/{h}.png" and by[1].n_media == 2 and by[3].content == "none"
    r = res.collect()
    assert len(r) == 1 and r[0].n_uses == 3 and r[0].path == f"m/{h}.png"
    back = {x.doc_id: x.content for x in M.self_contained(out.select("doc_id", "content"), res, "m").collect()}
    assert back == {1: f"see {uri_a} and {uri_a}", 2: f"also {uri_a}", 3: "none"}


def test_citations_numbered_by_first_use(spark):
    docs = spark.createDataFrame([(1, "a [@k2] b [@k9] c [@k1] d [@k2]")], "doc_id bigint, content string")
    bib = spark.createDataFrame([("k1", "one"), ("k2", "two")], "key string, entry string")
    res, miss = L.resolve_citations(L.citation_table(docs), bib)
    assert sorted(rows(res, "n", "key", "cite_no")) == [(1, "k2", 1), (3, "k1", 2), (4, "k2", 1)]
    assert rows(miss, "key") == [("k9",)]


def test_concat_across_ranges(spark):
    parts = spark.createDataFrame([(1, t, f"p{t}") for t in (5, 0, 3, 1, 4, 2)] + [(2, 0, "only")],
                                  "conv_id bigint, turn bigint, text string")
    got = {r.conv_id: (r.n_parts, r.text) for r in O.concat_documents(parts, "conv_id", "turn", bucket_width=2)
           .collect()}
    assert got == {1: (6, "p0\n\np1\n\np2\n\np3\n\np4\n\np5"), 2: (1, "only")}


def test_convert_distinct_equals_each(spark):
    text = "line one\nline <two>"
    docs = spark.createDataFrame([(1, text), (2, text), (3, "other")], "doc_id bigint, content string")
    got = {r.doc_id: r.converted for r in convert_distinct(docs, "plain", "html").collect()}
    assert got[1] == got[2] == "<p>line one</p>\n<p>line &lt;two&gt;</p>" and got[3] == "<p>other</p>"
