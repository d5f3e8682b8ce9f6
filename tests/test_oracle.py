"""Differential test: every query of the catalogue vs its DuckDB SQL (names, types, exact values) at sf0.001."""
import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001
from versio.plans import catalog

TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "array<string>": "VARCHAR[]"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(set(E.oracle_sql()) & set(catalog.queries())))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    rel = con.sql(E.oracle_sql()[name])
    want_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    got_types = {c: TYPES.get(t, t) for c, t in df.dtypes}
    assert got_types == want_types
    assert canon(df.columns, rows) == canon(rel.columns, rel.fetchall())
