"""Literal cases for every validation rule (P1) and the recorded decisions on the reference's quirks."""

from __future__ import annotations

import base64

import pytest
from pyspark.sql import functions as F

from quire.model import JobConfig
from quire.operators.validate import normalize_path, validate_requests, within_safe_dir
from quire.sources.fetch import crawl_from_pages, dispatch_fetch, replace_map
from quire.sources.requests import parse_requests

B64 = base64.b64encode(b"# Title\n\nSome text").decode()
PADDED = base64.b64encode(b"# Title\n\nSome text!").decode()


def body(fetcher='{"name":"data","params":{"data":"%s"}}' % B64, converter='{"from":"markdown","to":"html"}',
         template=""):
    parts = []
    if fetcher is not None:
        parts.append(f'"fetcher":{fetcher}')
    if converter is not None:
        parts.append(f'"converter":{converter}')
    parts.append(f'"template":"{template}"')
    return "{" + ",".join(parts) + "}"


CASES = [
    ("ok", body(), None),
    ("empty body", "", 1),
    ("cut body", body()[:-1], 1),
    ("wrong type", '{"converter": 5, "fetcher": {"name": "data"}}', 1),
    ("array body", "[]", 1),
    ("null body", "null", 2),
    ("no converter", body(converter=None), 2),
    ("no fetcher", body(fetcher=None), 3),
    ("data dir outside", body(converter='{"from":"markdown","to":"html","data_dir":"/etc"}'), 4),
    ("data dir sibling", body(converter='{"from":"markdown","to":"html","data_dir":"/app2"}'), 4),
    ("data dir climbs", body(converter='{"from":"markdown","to":"html","data_dir":"/app/../etc"}'), 4),
    ("data dir inside", body(converter='{"from":"markdown","to":"html","data_dir":"/app/x/../y"}'), None),
    ("empty name", body(fetcher='{"name":"","params":{}}'), 5),
    ("unknown name", body(fetcher='{"name":"ftp","params":{}}'), 6),
    ("no params", body(fetcher='{"name":"data"}'), 7),
    ("bad base64", body(fetcher='{"name":"data","params":{"data":"$$$$"}}'), 7),
    ("unpadded base64", body(fetcher='{"name":"data","params":{"data":"%s"}}' % PADDED.rstrip("=")), 7),
    ("empty payload", body(fetcher='{"name":"data","params":{"data":""}}'), 8),
    ("missing payload", body(fetcher='{"name":"data","params":{}}'), 8),
    ("http no url", body(fetcher='{"name":"http","params":{"method":"GET"}}'), 8),
    ("http bad method", body(fetcher='{"name":"http","params":{"url":"http://x/","method":"put"}}'), 8),
    ("http post ok", body(fetcher='{"name":"http","params":{"url":"http://x/","method":"post"}}'), None),
    ("trailing text", body() + " trailing", None),
    ("unknown keys", body(converter='{"from":"markdown","to":"html","colour":"red"}'), None),
]


@pytest.fixture(scope="module")
def validated(spark):
    raw = spark.createDataFrame([(i, b) for i, (_, b, _) in enumerate(CASES)], "request_id bigint, body string")
    return {r.request_id: r for r in validate_requests(parse_requests(raw)).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_rule(validated, i):
    name, _, want = CASES[i]
    got = validated[i]
    assert got.rule == want, (name, got.message)
    assert (got.message is None) == (want is None)


def test_messages(validated):
    by = {CASES[i][0]: validated[i].message for i in validated}
    assert by["no converter"] == "converter options is nil"
    assert by["no fetcher"] == "fetcher options is nil"
    assert by["unknown name"] == "fetcher ftp not exist"
    assert by["data dir outside"] == "DataDir: '/etc' is not in safe dir: '/app'"
    assert by["http bad method"] == "[fetcher-http]: method PUT not support"
    assert by["empty payload"] == "[fetcher-data]: params of data is empty"


def test_prefix_mode_keeps_reference_check(spark):
    """The reference compares a plain prefix, so /app2 and /app/../etc pass there; strict mode rejects them."""
    df = spark.createDataFrame([("/app2",), ("/app/../etc",), ("/app",), ("/app/x",), ("/etc",)], "p string")
    got = df.select("p", within_safe_dir(F.col("p"), "/app", "prefix").alias("a"),
                    within_safe_dir(F.col("p"), "/app", "strict").alias("b")).collect()
    assert [(r.p, r.a, r.b) for r in got] == [
        ("/app2", True, False), ("/app/../etc", True, False), ("/app", True, True), ("/app/x", True, True),
        ("/etc", False, False)]


def test_normalize_path(spark):
    df = spark.createDataFrame([("/a/./b//c/../d",), ("/../..",), ("a/b/..",), ("/",)], "p string")
    assert [r[0] for r in df.select(normalize_path(F.col("p"))).collect()] == ["/a/b/d", "/", "a", "/"]


def test_keys_are_case_sensitive(spark):
    """Go matches keys regardless of case; we document lower-case keys only, so 'Converter' is missing."""
    raw = spark.createDataFrame([(1, '{"Converter":{"from":"html","to":"html"},"fetcher":{"name":"data"}}')],
                                "request_id bigint, body string")
    assert validate_requests(parse_requests(raw)).first().rule == 2


def test_option_errors(spark):
    raw = spark.createDataFrame([
        (1, body(converter='{"from":"markdown","to":"pdf"}')),
        (2, body(converter='{"from":"markdown","to":"html","wrap":"sideways"}')),
        (3, body(converter='{"from":"docx","to":"html"}')),
        (4, body(converter='{"from":"markdown","to":"html","email_obfuscation":"javascript"}')),
    ], "request_id bigint, body string")
    got = {r.request_id: r.conv_error for r in validate_requests(parse_requests(raw)).collect()}
    assert got[1] == "output format 'pdf' is not supported"
    assert got[2] == "unknown value 'sideways' for option wrap"
    assert got[3] == "input format 'docx' is not supported"
    assert got[4] == "email_obfuscation javascript is not built"


def test_fetch_snapshot_and_replace(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>hello world</p>"), (10, "http://b/", "<p>x</p>")],
                                  "page_id bigint, url string, html string")
    raw = spark.createDataFrame([
        (1, body(fetcher='{"name":"http","params":{"url":"http://a/","replace":{"world":"there","hello":"hi"}}}')),
        (2, body(fetcher='{"name":"http","params":{"url":"http://b/"}}')),
        (3, body(fetcher='{"name":"http","params":{"url":"http://c/"}}')),
    ], "request_id bigint, body string")
    v = validate_requests(parse_requests(raw))
    out = {r.request_id: r for r in dispatch_fetch(v, JobConfig(), {"http": {"crawl": crawl_from_pages(pages)}})
           .collect()}
    assert bytes(out[1].data) == b"<p>hi there</p>"
    assert out[2].fetch_error == "[fetcher-http]: fetch url by GET failure <http://b/>, status code is 404"
    assert out[3].fetch_error.endswith("no snapshot")


def test_replace_map_empty_key_is_noop(spark):
    """An empty key inserts between characters in Go; here it changes nothing. Keys apply in ascending order."""
    df = spark.createDataFrame([("abc",)], "t string")
    # 'Bc' sorts before 'b': it finds nothing, then 'b' -> 'B'. The other order would give 'aZ'.
    m = F.create_map(F.lit(""), F.lit("x"), F.lit("b"), F.lit("B"), F.lit("Bc"), F.lit("Z"))
    assert df.select(replace_map(F.col("t"), m)).first()[0] == "aBc"
