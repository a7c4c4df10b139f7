"""Every query against its SQL, and those without SQL for their shape, over the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest
from conftest import SF

from cairn.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def value(x):
    return None if isinstance(x, float) and math.isnan(x) else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(map(value, r)) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(map(value, r)) for r in df.select(*cols).collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5 and set(e.oracle_sql()) <= set(e.queries())
