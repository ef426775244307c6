"""Every job with an oracle matches DuckDB on the smallest scale (the driver's gate
runs the same comparison at sf0.01; see tools/check_oracle.py)."""

import duckdb
import pytest

import __spark_entry__ as E
from editlens.session import TABLES
from tools.check_oracle import rows_of

from .conftest import SF001

ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF001}/{t}.parquet')")
    c.execute("set TimeZone='UTC'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF001)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLE[name])
    d_cols, d_rows = [c[0] for c in cur.description], cur.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert rows_of(s_cols, s_rows) == rows_of(d_cols, d_rows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "label" in df.columns


def test_every_query_has_a_name_from_the_inventory():
    for name in E.queries():
        assert name.split("_")[0][0] in "psjoawcegmt", name


ROWS_ONLY = sorted(set(E.queries()) - set(ORACLE))


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_jobs_run(spark, name):
    df = E.queries()[name](spark, SF001)
    assert df.count() > 0
