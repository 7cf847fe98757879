"""Every registered query against its SQL in DuckDB, on the smallest driver tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
from trackloom.plans import catalog  # noqa: E402

DATA = os.environ.get("TRACKLOOM_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{DATA}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


def in_order(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in at], sorted(tuple(plain(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sql, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = in_order(df.columns, df.collect())
    assert df.columns
    if name in catalog.SQL:
        cur = sql.execute(catalog.SQL[name])
        assert got == in_order([d[0] for d in cur.description], cur.fetchall())
