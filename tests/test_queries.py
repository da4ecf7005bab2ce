"""Every query with SQL against DuckDB over the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

from .conftest import DATA

NAMES = sorted(n for n in entry.oracle_sql() if n in entry.registry.QUERIES)


@pytest.fixture(scope="session")
def duck(small):
    connection = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return connection


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return int(value) if isinstance(value, int) and not isinstance(value, bool) else value


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, small, name):
    found = entry.queries()[name](spark, small)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(found.columns) == sorted(columns)
    want = sorted((tuple(normal(v) for v in r) for r in result.fetchall()), key=str)
    got = sorted((tuple(normal(r[c]) for c in columns) for r in found.collect()), key=str)
    assert len(got) == len(want) and got == want
    assert got


def test_entry(spark):
    assert DATA.exists() and entry.entry(spark).count() > 0
