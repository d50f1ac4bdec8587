"""Every registered query against its SQL on the smallest fixture tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as registry
from corpusgauge.plans.oracles import ORACLES
from corpusgauge.plans.queries import QUERIES
from tools.check_oracles import TABLES, rows_of

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="fixture tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    result = registry.queries()[name](spark, str(SF))
    relation = duck.sql(registry.oracle_sql()[name])
    assert sorted(result.columns) == sorted(relation.columns)
    got = rows_of(result.columns, result.collect())
    wanted = rows_of(list(relation.columns), relation.fetchall())
    assert len(got) == len(wanted) > 0
    assert got == wanted


def test_entry(spark):
    assert registry.entry(spark).count() > 0
