"""Every query with SQL gives DuckDB's rows on the smallest tables; those without SQL run."""

import datetime
import math
import os

import pytest

from cladeframe.plans import more_queries, record_queries, report_queries, search_queries  # noqa: F401
from cladeframe.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 7)
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    if name in ORACLE_SQL:
        found = duck.sql(ORACLE_SQL[name])
        assert got == rows_of(found.columns, found.fetchall())
    else:
        assert got[1]
