"""Every registered query with an SQL twin gives DuckDB's rows on the smallest tables."""

import math

import duckdb
import pytest

from pagequarry.plans import catalog
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


def tidy(v):
    return (None if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(([tidy(r[c]) for c in cols] for r in df.collect()), key=repr)
    q = con.sql(catalog.oracle_sql()[name])
    assert sorted(q.columns) == cols
    want = sorted(([tidy(dict(zip(q.columns, r))[c]) for c in cols] for r in q.fetchall()), key=repr)
    assert got == want and got


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_library_stands_without_llm():
    from pathlib import Path

    root = Path(catalog.__file__).resolve().parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "pagequarry.llm" not in f.read_text(), f
