"""Queries of this subpackage that SQL can express, against DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from premia.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    folder = sf_dir.replace("0.001", "0.01")
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    theirs = con.execute(ORACLE_SQL[name])
    names, rows = [d[0] for d in theirs.description], theirs.fetchall()
    ours = QUERIES[name](spark, folder)
    assert sorted(ours.columns) == sorted(names)
    assert sorted(map(tuple, ours.select(*names).collect()), key=str) == sorted(rows, key=str) and rows
