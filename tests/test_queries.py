"""Every registered decision query against its SQL, in DuckDB on the same tables."""

import os

import duckdb
import pytest

from gatewright.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = frame.astype(object).where(frame.notna(), None)
    return sorted(repr([float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r]) for r in clean.values.tolist())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS FROM '{SF}/{file}'")
    return con


#: Fitted by Newton steps; tests/test_follow_up.py holds their weights against NumPy and their scores against SQL.
NO_SQL = {"rank_joint", "eval_joint"}


def test_each_query_has_sql():
    assert QUERIES.keys() == ORACLE_SQL.keys() | NO_SQL and not ORACLE_SQL.keys() & NO_SQL


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_same_rows(spark, duck, name):
    got, expected = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
