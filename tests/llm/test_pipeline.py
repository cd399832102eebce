"""The registered queries against their SQL, and the pipeline against its stages worked out by brute force."""

from __future__ import annotations

import hashlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as P
from quire.llm import catalog, op7_crf_quality
from quire.session import TABLES
from tests.conftest import SMALL
from tests.llm.data import documents, rows
from tests.llm.test_free import bpe  # noqa: F401
from tests.llm.test_free import groups_brute
from tests.llm.test_native import contaminated_brute, dedup_brute, norm
from tools.check_oracle import digest


def test_all_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in catalog.QUERIES}
    assert set(catalog.QUERIES) | {"pipeline"} <= set(names) and set(catalog.SQL) <= set(entry.oracle_sql())
    assert P.ORACLE_SQL is None and len(P.STAGES) == 5


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    df = catalog.QUERIES[name](spark, SMALL)
    got = [tuple(r) for r in df.collect()]
    rel = con.execute(catalog.SQL[name])
    columns = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(columns)
    assert digest(df.columns, got)[0] == digest(columns, rel.fetchall())[0]


def brute(docs, labels, items, codec):
    """Rows of run() for (doc_id, text) rows; the model comes from the operator, everything else from its definition."""
    model = op7_crf_quality.train(docs, labels.where(~op7_crf_quality.held_out("doc_id")))
    kept = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    scores = op7_crf_quality.scores([(t or "").encode() for _, t in kept], model)
    kept = [r for r, s in zip(kept, scores) if s >= 0.3]
    left = dedup_brute(kept)
    new = [(d, t if t is None else left[d, t], t) for d, t in kept]
    kept = [(d, t) for d, t, old in new if t == old or norm(t)]  # what is left of a document is its own
    groups = {(d, least) for (d, _, least) in groups_brute(kept)}
    kept = [(d, t) for d, t in kept if (d, d) in groups or d is None]
    kept = [r for r, (_, hit, _) in zip(kept, contaminated_brute([t for _, t in kept], items)) if not hit]
    out = Counter()
    for d, t in kept:
        ids = codec.encode_ordinary(t or "")
        out[d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("given", [True, False])
def test_pipeline_like_brute_force(spark, bpe, tmp_path, given):  # noqa: F811
    if given:
        path = tmp_path
        for t in ("documents", "labels", "benchmark"):
            spark.read.parquet(f"{SMALL}/{t}.parquet").where("doc_id < 120" if t != "benchmark" else "true").write.parquet(str(path / f"{t}.parquet"))
    else:  # awkward rows, with names that the stages use inside
        path = tmp_path
        documents(spark).where("doc_id is null or doc_id not in (8, 9, 10)").withColumn("n_removed", F.lit("x")).write.parquet(
            str(path / "documents.parquet"))
        spark.createDataFrame([(1, 1, 0), (100, 1, 0), (101, 1, 0), (102, 1, 0), (12, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(
            str(path / "labels.parquet"))
        spark.createDataFrame([(1, rows()[-1][1][:150]), (2, None)], "item_id bigint, text string").write.parquet(str(path / "benchmark.parquet"))
    got = P.run(spark, str(path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    read = lambda t: spark.read.parquet(str(path / f"{t}.parquet"))
    items = [(r.item_id, r.text) for r in read("benchmark").collect()]
    want = brute(read("documents"), read("labels"), items, bpe[1])
    assert Counter(map(tuple, got)) == want and len(got) > 5


def test_stages_keep_the_columns(spark, tmp_path):
    df = documents(spark).where("doc_id >= 100").withColumn("n_lines", F.lit(1)).withColumn("items", F.lit(2)).withColumn("_out", F.lit(3))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.dtypes == df.dtypes and out.count() == df.count(), name
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
    assert P.STAGES[-1][1](spark, df.limit(0), str(tmp_path)).count() == 0
