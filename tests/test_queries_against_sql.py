"""Every registered query on the smallest tables: against its SQL twin where it has one."""

from __future__ import annotations

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
INVENTORY = {
    "f": range(1, 34), "s": range(1, 11), "j": range(1, 10), "a": range(1, 20), "w": range(1, 13),
    "o": range(1, 4), "u": range(1, 5), "x": range(1, 30), "t": range(1, 9), "e": range(1, 7),
}


@pytest.fixture(scope="module")
def duck(sf):
    base = duckdb.connect()
    for table in TABLES:
        base.sql(f"CREATE VIEW {table} AS SELECT * FROM '{Path(sf) / table}.parquet'")
    return base


def test_every_operator_has_a_query():
    found = {m.group(1) for m in (re.match(r"([a-z]\d\d)_", n) for n in QUERIES) if m}
    wanted = {f"{kind}{i:02d}" for kind, ids in INVENTORY.items() for i in ids}
    assert wanted - found == set()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, sf, name):
    got = rows_of(QUERIES[name](spark, sf).toPandas())
    want = rows_of(duck.sql(ORACLES[name]).df())
    assert got[0] == want[0]
    assert got[2] == want[2]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_and_has_rows(spark, sf, name):
    assert not QUERIES[name](spark, sf).isEmpty()
