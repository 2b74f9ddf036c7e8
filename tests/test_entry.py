"""The driver's contract, on the smallest tables, against DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from inkglass.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple("" if v is None else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    names = sorted(got.columns)
    told = duck.execute(catalogue.oracle_sql()[name])
    order = [d[0] for d in told.description]
    assert sorted(order) == names
    expected = [[r[order.index(n)] for n in names] for r in told.fetchall()]
    assert plain(got.select(*[f"`{n}`" for n in names]).collect()) == plain(expected)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() >= 0


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
