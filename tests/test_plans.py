"""Registry rules (X1, X1b, X2, X3), plan shape checks, properties, and the streaming text source."""

from __future__ import annotations

import json
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.plans.catalog import QUERIES
from quire.functions import codecs as C
from quire.model import FetcherConf, JobConfig
from quire.operators import blocks as B
from quire.operators import normalize as N
from quire.operators import render as R
from quire.operators.media import fail_if_warnings
from quire.plans import registry as X
from quire.session import scratch_path
from quire.streaming.stream import convert_stream
from tests.conftest import SMALL


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# --- registry ------------------------------------------------------------------------------------------------------

def test_register_fetcher_rules():
    with pytest.raises(X.RegistryError, match="empty"):
        X.register_fetcher("", lambda df, o: df)
    with pytest.raises(X.RegistryError, match="nil"):
        X.register_fetcher("x-none", None)
    X.configure_fetchers(JobConfig())  # registers the built-in drivers
    with pytest.raises(X.RegistryError, match="already exist"):
        X.register_fetcher("data", lambda df, o: df)
    with pytest.raises(X.RegistryError, match="not exist"):
        X.fetch_driver("oss")


@pytest.mark.parametrize("fetchers,msg", [
    ((("", FetcherConf("data")),), "could not be"),
    ((("default", FetcherConf("data")),), "could not be"),
    ((("a", FetcherConf("data")), ("a", FetcherConf("http"))), "already exist"),
    ((("a", FetcherConf("")),), "driver is empty"),
    ((("a", FetcherConf("oss")),), "not exist"),
])
def test_configure_fetchers_rules(fetchers, msg):
    with pytest.raises(X.RegistryError, match=msg):
        X.configure_fetchers(JobConfig(fetchers=fetchers))


def test_named_instances_route_to_drivers(spark):
    conf = JobConfig(fetchers=(("inline", FetcherConf("data")), ("web", FetcherConf("http"))))
    assert X.configure_fetchers(conf) == {"inline": "data", "web": "http"}
    assert sorted(r.name for r in X.registry_frame(spark, conf).collect()) == ["inline", "web"]


def test_register_template_rules():
    X.register_template("plain-json", lambda o, to: F.to_json(o))
    with pytest.raises(X.RegistryError):
        X.register_template("plain-json", lambda o, to: o)
    with pytest.raises(X.RegistryError):
        X.register_template("bad", "not callable")


def test_block_filter_gate(spark):
    b = spark.createDataFrame([(1, 1, "para", 0, "x")], "doc_id bigint, block_no int, kind string, level int, text string")
    drop_all = lambda df: df.filter(F.lit(False))
    assert X.block_filter(b, drop_all, enabled=False).count() == 1
    assert X.block_filter(b, drop_all, enabled=True).count() == 0
    with pytest.raises(X.RegistryError):
        X.block_filter(b, lambda df: df.drop("text"), enabled=True)


def test_fail_if_warnings(spark):
    w = spark.createDataFrame([(1, "html_unclosed", "no </body>")], "doc_id bigint, kind string, detail string")
    assert fail_if_warnings(w, enabled=False) is w
    with pytest.raises(RuntimeError):
        fail_if_warnings(w, enabled=True)


# --- plans ---------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_evaluation_in_plans(spark, name):
    if name in ("convert_stream", "write_documents", "fetch_files", "read_requests_stream", "convert_with_files"):
        pytest.skip("writes scratch data when built")
    plan = physical(QUERIES[name](spark, SMALL))
    assert "EvalPython" not in plan and "PythonUDF" not in plan and "MapInPandas" not in plan


def test_scan_reads_only_needed_columns(spark):
    plan = physical(QUERIES["html_to_plain"](spark, SMALL))
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan or "struct<page_id:bigint,html:string>" in plan
    assert "url" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_regroup_reuses_document_partitioning(spark):
    """explode -> filter -> groupBy(doc_id): one exchange at most (the spread of a single-split input)."""
    plan = physical(QUERIES["html_to_plain"](spark, SMALL))
    assert plan.count("Exchange") <= 1


def test_in_row_conversion_has_no_shuffle(spark):
    docs = spark.range(0, 64, numPartitions=16).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("<h1>T"), F.col("id").cast("string"), F.lit("</h1><p>x</p>"))
        .alias("content"))
    out = docs.select("doc_id", R.render_html(B.drop_empty_paras(B.html_block_array(F.col("content")))))
    assert "Exchange" not in physical(out)


# --- properties ----------------------------------------------------------------------------------------------------

texts = st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=60), min_size=1, max_size=25)


@settings(max_examples=12, deadline=None)
@given(texts)
def test_base64_round_trip(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "t string")
    back = df.select(F.decode(C.b64_decode(C.b64_encode(C.utf8(F.col("t")))), "UTF-8")).collect()
    assert [r[0] for r in back] == xs


@settings(max_examples=12, deadline=None)
@given(texts)
def test_escape_round_trip(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "t string")
    back = df.select(C.html_unescape(C.html_escape(F.col("t")))).collect()
    assert [r[0] for r in back] == xs


words = st.lists(st.text(alphabet="abcdefghij", min_size=1, max_size=30), min_size=0, max_size=40)


@settings(max_examples=12, deadline=None)
@given(st.lists(words, min_size=1, max_size=10))
def test_wrap_keeps_words_and_width(spark, docs):
    lines = [" ".join(w) for w in docs]
    df = spark.createDataFrame([(ln,) for ln in lines], "t string")
    out = [r[0] for r in df.select(N.wrap(F.col("t"), "auto", 20)).collect()]
    for src, got in zip(lines, out):
        assert got.split() == src.split()
        assert all(len(x) <= 20 or " " not in x for x in got.split("\n"))


# --- streaming text source (S2) ------------------------------------------------------------------------------------

def test_stream_of_json_lines(spark):
    run = scratch_path(spark, f"s2-{uuid.uuid4().hex}")
    good = {"request_id": 1, "fetcher": {"name": "data", "params": {"data": "IyBUaXRsZQ=="}},
            "converter": {"from": "markdown", "to": "html"}, "template": ""}
    bad = {"request_id": 2, "converter": {"from": "markdown", "to": "html"}}
    spark.createDataFrame([(json.dumps(good),), (json.dumps(bad),)], "value string").coalesce(1).write.text(f"{run}/in")
    convert_stream(spark, f"{run}/in", f"{run}/out", f"{run}/ckpt", source_format="text")
    got = {r.request_id: r for r in spark.read.parquet(f"{run}/out").collect()}
    assert got[1].code == 0 and bytes(got[1].data) == b"<h1>Title</h1>"
    assert got[2].code == 400 and got[2].message == "fetcher options is nil"


# --- the in-row (conversion job) and table (analytics) forms of the outline agree ---------------------------------

from quire.operators import inrow as IR  # noqa: E402
from quire.operators import outline as OL  # noqa: E402

outline = st.lists(st.tuples(st.integers(1, 6), st.sampled_from(["Intro", "Part A", "part-a", "Notes", "1 One"])),
                   min_size=1, max_size=30)


@settings(max_examples=15, deadline=None)
@given(outline)
def test_inrow_outline_equals_table_outline(spark, heads):
    data = [(1, i + 1, "heading", lv, t) for i, (lv, t) in enumerate(heads)]
    b = spark.createDataFrame(data, "doc_id bigint, block_no int, kind string, level int, text string")
    table_nums = [r.number for r in OL.number_sections(b, 2).orderBy("block_no").collect()]
    table_ids = [r.id for r in OL.header_ids(b, "p-").orderBy("block_no").collect()]
    arr = b.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_no", "kind", "level", "text"))).alias("a"))
    r = arr.select(IR.section_numbers(F.col("a"), F.lit(2)).alias("n"), IR.heading_ids(F.col("a"), F.lit("p-"))
                   .alias("i")).first()
    assert r.n == table_nums
    assert r.i == table_ids


def test_cluster_conf_applies(spark):
    """Every cluster setting is accepted by the session and reads back (restored afterwards: the session is shared)."""
    from quire.session import CLUSTER_CONF, apply_cluster_conf

    before = {k: spark.conf.get(k, None) for k in CLUSTER_CONF}
    try:
        apply_cluster_conf(spark)
        for k, v in CLUSTER_CONF.items():
            got = spark.conf.get(k)
            assert got is not None and (got == v or got.lower().startswith(v.rstrip("m").lower())), (k, got)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
