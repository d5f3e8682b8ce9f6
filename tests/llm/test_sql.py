"""Differential test: the queries with SQL vs DuckDB at sf0.001 (names, types, exact values)."""
import duckdb
import pytest

from conftest import SF001
from versio.llm import queries

TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    df = queries.queries()[name](spark, SF001)
    rel = con.sql(queries.oracle_sql()[name])
    assert {c: TYPES[t] for c, t in df.dtypes} == dict(zip(rel.columns, map(str, rel.types), strict=True))
    cols = sorted(rel.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
