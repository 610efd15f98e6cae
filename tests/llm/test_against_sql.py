"""The corpus queries that have SQL, on given tables, against DuckDB."""

import os

import duckdb
import pytest

from memlake.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, name):
    frame = queries.QUERIES[name](spark, DATA)
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    columns = sorted(frame.columns)
    cursor = con.execute(queries.ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = sorted([plain(r[names.index(c)]) for c in columns] for r in cursor.fetchall())
    assert sorted([plain(r[c]) for c in columns] for r in frame.collect()) == expected
