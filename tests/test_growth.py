"""Steps that must grow with the input only, and inputs with repeated keys."""

import base64

from pyspark.sql import functions as F

from quire.functions.codecs import b64_decode, b64_encode, b64_valid
from quire.model import JobConfig
from quire.operators import media as M
from quire.operators import normalize as N
from quire.plans import convert as C
from quire.plans import queries_io, queries_side
from quire.sources.fetch import dispatch_fetch
from quire.operators.validate import validate_requests

FILES = "f_path string, f_bytes binary"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def requests(spark, **options):
    docs = spark.createDataFrame([(1, "a [@k1] b"), (2, "c ![x](img/1.png)")], "doc_id long, content string")
    return queries_side.requests(docs, **{"from": "plain"}, to="html", **options)


def test_base64_of_all_forms(spark):
    long = bytes(range(256)) * 3
    texts = [base64.b64encode(long).decode(), base64.encodebytes(long).decode(), "QQ==", "QQ=\r\n=", "", "QQ", "Q===", "QQ=Q", "Q$==", "QQE ", "QQ==\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select(
        "i", b64_valid(F.col("s")).alias("v"), b64_decode(F.col("s")).alias("d"), b64_encode(b64_decode(F.col("s"))).alias("e")).orderBy("i").collect()
    assert [None if r.d is None else bytes(r.d) for r in rows] == [long, long, b"A", b"A", b"", None, None, None, None, None, b"A"]
    assert [r.v for r in rows][:9] == [True] * 5 + [False] * 4
    assert rows[0].e == rows[1].e == texts[0]


def test_job_builds_no_string_per_character(spark):
    assert "translate(" not in optimized(C.convert_job(requests(spark)))


def test_job_without_crawl_reads_requests_once(spark):
    f = dispatch_fetch(validate_requests(requests(spark)), JobConfig())
    assert "Union" not in optimized(f)
    bodies = [(1, '{"fetcher":{"name":"http","params":{"url":"http://a.b/"}},"converter":{"from":"html","to":"plain"}}')]
    from quire.sources.requests import parse_requests

    r = C.convert_job(parse_requests(spark.createDataFrame(bodies, "request_id long, body string"))).first()
    assert (r.code, r.rule, r.message) == (400, 9, "[fetcher-http]: no crawl snapshot table is configured")


def test_side_files_do_not_parse_requests_again(spark):
    files = spark.createDataFrame([("/app/b.bib", bytearray(b"@article{k1,\n  title = {T}\n}\n")), ("/app/d/img/1.png", bytearray())], FILES)
    f = dispatch_fetch(validate_requests(requests(spark, bibliography="/app/b.bib", resource_path="/app/d")), JobConfig())
    side = C.side_table(f, files, JobConfig(), None)
    assert "from_json(body" not in optimized(side)
    got = {r.request_id: (r.cites, r.paths) for r in side.collect()}
    assert got == {1: ({"k1": "T."}, None), 2: (None, {"img/1.png": "/app/d/img/1.png"})}


def test_file_scheme_of_a_page_crawled_twice(spark, tmp_path):
    for name, rows, schema in (
            ("documents", [(i, f"text {i}", "en", "s", 6) for i in range(12)], "doc_id long, text string, lang string, source string, n_chars long"),
            ("pages", [(1, "http://a.b/1", "<p>x</p>"), (2, "http://a.b/2", "<p>y</p>"), (3, "http://a.b/2", "<p>y</p>")], "page_id long, url string, html string"),
            ("benchmark", [(0, "i0"), (1, "i1")], "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = queries_side.convert_file_schemes(spark, str(tmp_path)).collect()
    assert sorted(r.request_id for r in got) == list(range(12))
    assert {r.request_id: r.code for r in got if r.request_id % 3 == 2} == {2: 0, 5: 0, 8: 0, 11: 0}


def test_summary_runs_each_stage_once(spark):
    docs = spark.createDataFrame([(1, "a", "x\ty a@b.cd"), (2, "a", "plain")], "doc_id long, source string, content string")
    out = N.normalize_summary(N.normalize_corpus(docs, N.NormalizeOptions(), keep=("source",)))
    assert not any("regexp" in line for line in optimized(out).splitlines() if "Filter" in line.split("(")[0])
    assert {(r.stage, r.n_docs) for r in out.collect()} == {("expand_tabs", 1), ("email_obfuscation", 1), ("wrap", 1)}


def test_stream_files_grow_with_the_requests(spark, monkeypatch, tmp_path):
    spark.createDataFrame([(i, f"text {i}", "en", "s", 6) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "http://a.b/1", "<p>x</p>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    made = []
    monkeypatch.setattr(queries_io, "ROWS_PER_FILE", 6)
    monkeypatch.setattr(queries_io, "_run_dir", lambda s, n, f=queries_io._run_dir: made.append(f(s, n)) or made[-1])
    assert queries_io.read_requests_stream(spark, str(tmp_path)).count() == 60
    assert len(spark.read.text(f"{made[0]}/in").inputFiles()) == 10


def test_media_reference_in_nested_folders(spark):
    h = "0123456789abcdef" * 2
    texts = [f"a/b.c/{h}.png", f"x{h}.png", f"d/{h}.png/zzz", f"a//{h}.gif", "a/b/c", f"q {h[:31]}.png"]
    old = r"(?:[A-Za-z0-9_.~-]+/)*([0-9a-f]{32})\.[A-Za-z0-9]+"
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(*[
        F.regexp_extract_all("t", F.lit(p), 0) for p in (M.ANY_MEDIA_REF_RE, old)]).collect()
    assert all(r[0] == r[1] for r in rows) and sum(len(r[0]) for r in rows) == 4
