"""Every registered query against its DuckDB text, on the smallest scale."""

import duckdb
import pytest
from oracle_check import TABLES, compare

from newsweave.catalog import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLE:
        _, problem = compare(df, con, ORACLE[name])
        assert problem is None, problem
    else:
        assert df.count() > 0


def test_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["topic", "article_count", "interaction_count"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
