"""Every query with SQL against DuckDB at the smallest size; every other one returns rows."""

import math
import os

import duckdb
import pytest

from palimpsest import queries as q

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in sorted(os.listdir(DIR)):
        if f.endswith(".parquet"):
            c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return c


def plain(v):
    if v is None or str(v) in ("NaT", "<NA>") or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):  # a whole number beside nulls is a float in pandas
        return str(int(v)) if v.is_integer() else float(v)
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", list(q.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    assert rows(q.QUERIES[name](spark, DIR).toPandas()) == rows(duck.sql(q.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", [n for n in q.QUERIES if n not in q.ORACLE_SQL])
def test_rows(spark, name):
    assert q.QUERIES[name](spark, DIR).count() > 0


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "sensitivity_level", "integrity", "priority_score", "priority_label", "rank"]
    assert set(q.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
