"""The queries that SQL can express, against DuckDB."""

import duckdb
import pytest
from oracle_check import TABLES, compare

from newsweave.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    _, problem = compare(QUERIES[name](spark, sf), con, ORACLE[name])
    assert problem is None, problem


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
