"""Every query against its SQL in DuckDB over the same tables."""

import glob
import math
import os

import duckdb
import pytest

from corpusloom import queries as core

QUERIES, SQL = core.queries(), core.oracle_sql()


@pytest.fixture(scope="module")
def duck(folder):
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 8)
    return value


def rows(columns, values):
    return sorted((tuple(plain(v[c]) for c in columns) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, folder, name):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = rows(columns, [r.asDict() for r in df.collect()])
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == rows(columns, [dict(zip(names, r)) for r in cursor.fetchall()])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_entry(spark, folder):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    if folder.endswith("sf0.001"):
        assert entry.entry(spark).count() > 0
