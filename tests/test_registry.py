"""Every registered query of the engine against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from latticeq import registry

WHERE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in registry.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{WHERE}/{name}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.skipif(not os.path.isdir(WHERE), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_duckdb(spark, duck, name):
    df = registry.QUERIES[name](spark, WHERE)
    columns = sorted(df.columns)
    got = sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())
    found = duck.sql(registry.ORACLES[name])
    assert sorted(found.columns) == columns
    assert got == sorted(tuple(normal(r[found.columns.index(c)]) for c in columns) for r in found.fetchall())
