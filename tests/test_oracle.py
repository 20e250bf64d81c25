"""Every registered query with an oracle matches DuckDB on the sf0.001 tables."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracle import TABLES, canon

ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, sf, con, name):
    df = E.queries()[name](spark, sf)
    cur = con.execute(ORACLES[name])
    dcols = [d[0] for d in cur.description]
    sc, sr = canon(df.columns, [tuple(r) for r in df.collect()])
    dc, dr = canon(dcols, cur.fetchall())
    assert sc == dc
    assert sr == dr


def test_every_query_runs(spark, sf):
    for name, fn in E.queries().items():
        if name in ORACLES:
            continue
        df = fn(spark, sf)
        assert df.count() >= 0, name


def test_entry(spark):
    assert E.entry(spark).count() > 0
