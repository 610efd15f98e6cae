"""Every query of the engine that has SQL, on the smallest tables, against DuckDB."""

import datetime
import math
import os

import duckdb
import pytest

from memlake.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, str):
        return v
    return "nan" if isinstance(v, float) and math.isnan(v) else f"{float(v):.9g}" if not isinstance(v, int) else str(v)


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def number(x):
    try:
        return f"{float(x):.9g}"
    except ValueError:
        return x


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query(spark, database, name):
    frame = catalog.QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    got = sorted(str([number(x) if isinstance(x, str) else x for x in (plain(r[c]) for c in columns)]) for r in frame.collect())
    cursor = database.execute(catalog.ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = sorted(str([number(x) if isinstance(x, str) else x for x in (plain(r[k]) for k in at)]) for r in cursor.fetchall())
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
