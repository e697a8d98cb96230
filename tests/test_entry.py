"""The registered queries run over the smallest tables with the schema their SQL gives, and equal it."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def connection(data):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.6g}"
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("+00:00", "")
    return str(v)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(n for n in entry.queries()))
def test_query(spark, connection, data, name):
    df = entry.queries()[name](spark, data)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql:
        cursor = connection.execute(sql)
        names = [x[0] for x in cursor.description]
        assert sorted(names) == columns
        assert rows == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
