"""Every registered query against its check SQL on the smallest data."""

import duckdb
import pytest

from __spark_entry__ import entry
from lakegraph.plans import ORACLES, QUERIES
from lakegraph.sources.derive import TABLES
from tools.check import forbidden_nodes, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_check_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    assert not forbidden_nodes(df)
    sql = ORACLES.get(name)
    if sql is None:
        assert got
        return
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, got) == rows_of(columns, cur.fetchall())


def test_entry(spark):
    rows = entry(spark).collect()
    assert rows and all(r.start == "/sources/supplier-1.md" for r in rows)
