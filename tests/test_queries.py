"""Every query of the graph engine against its SQL in DuckDB, at the smallest size."""

import math
import os

import duckdb
import pytest

from ripplegraph.plans import registry

DATA = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in os.listdir(DATA):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return connection


def plain(v):
    return ("nan" if math.isnan(v) else f"{v + 0.0:.9g}") if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, tables, name):
    found = registry.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    if name not in registry.ORACLES:
        assert len(got) > 0
        return
    result = tables.execute(registry.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
