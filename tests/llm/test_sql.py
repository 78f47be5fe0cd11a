"""Queries that SQL can express give DuckDB's rows."""

from __future__ import annotations

import duckdb
import pytest

from tests.test_oracles import TABLES, plain
from tidemark.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    found = db.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    want = sorted(([plain(r[names.index(c)]) for c in cols] for r in found.fetchall()), key=repr)
    assert sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=repr) == want


def test_patterns_decide_some_url(spark):
    df = queries.op2_url_filters(spark, "/root/testdata/sf0.1")
    assert df.where("rule is null and verdict = 'block'").count() > 0
