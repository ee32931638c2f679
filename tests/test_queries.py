"""Every registered query of the library against its SQL twin in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from tidemark.plans import registry

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return con


def plain(v):
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    return repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, duck, name):
    df = registry.QUERIES[name](spark, data)
    rows, columns = df.collect(), sorted(df.columns)
    if name not in registry.ORACLE:
        assert rows
        return
    r = duck.sql(registry.ORACLE[name])
    kinds, at = dict(zip(r.columns, map(str, r.types), strict=True)), {c: i for i, c in enumerate(r.columns)}
    assert sorted(kinds) == columns
    assert {c: TYPES.get(t) for c, t in df.dtypes} == kinds
    got = sorted(([plain(x[c]) for c in columns] for x in rows), key=str)
    assert got == sorted(([plain(x[at[c]]) for c in columns] for x in r.fetchall()), key=str)


def test_entry_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
