"""Every query with SQL gives DuckDB's rows on sf0.001; the package imports and the entry runs."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__
from spanforge.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(table, names):
    cell = lambda v: round(v, 6) if isinstance(v, float) else v
    return Counter(tuple(repr(cell(v)) for v in r) for r in zip(*(table.column(n).to_pylist() for n in names)))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    want = duck.execute(catalogue.ORACLE_SQL[name]).to_arrow_table()
    got = catalogue.QUERIES[name](spark, SF).toArrow()
    names = sorted(want.column_names)
    assert names == sorted(got.column_names)
    assert rows(got, names) == rows(want, names)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns[:3] == ["chrom", "start", "end"]
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
