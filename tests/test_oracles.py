"""Every query that has SQL gives the rows that DuckDB gives on the same files."""

import os

import duckdb
import pytest

from meterloom.plans import queries

SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return con


def rows(columns, values):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(repr(tuple(v[i] for i in order)) for v in values)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, data, db, name):
    got, want = queries.queries()[name](spark, data), db.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert rows(got.columns, map(tuple, got.collect())) == rows(columns, want.fetchall())


def test_entry(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
