"""Queries of the subpackage that SQL can express, against DuckDB on the same tables: names, kinds of columns and all rows."""

import duckdb
import pytest

from pagequarry.llm import queries
from tests.conftest import DATA


@pytest.mark.parametrize("name", ["op6_near_duplicates", "op7_warc_archives"])
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"create view {table} as from '{DATA}/{table}.parquet'")
    df, want = queries.queries()[name](spark, DATA), con.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert {c: kinds[t] for c, t in df.dtypes} == dict(zip(want.columns, map(str, want.types)))
    assert sorted(map(repr, map(tuple, df.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))
