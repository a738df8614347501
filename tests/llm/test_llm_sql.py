"""Operators whose whole result SQL can express, against that SQL."""

import duckdb
import pytest
from conftest import SF001

from stancekit.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF001)
    got = sorted(map(tuple, df.collect()), key=repr)
    want = duck.sql(ORACLE[name])
    assert sorted(want.columns) == sorted(df.columns)
    at = [want.columns.index(c) for c in df.columns]
    assert got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
