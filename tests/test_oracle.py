"""Every registered query against its DuckDB oracle on the smallest test tables (whole-result compare)."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from quire.plans.catalog import QUERIES, SQL
from quire.session import TABLES
from tests.conftest import SMALL
from tools.check_oracle import digest


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    yield con
    con.close()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["doc_id", "code", "message", "n_chars", "response_md5"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    got = [tuple(r) for r in df.collect()]
    rel = duck.sql(SQL[name])
    want = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(got) == len(want)
    assert digest(df.columns, got)[0] == digest(rel.columns, want)[0]
