"""Every query that SQL can express, against DuckDB on the smallest tables; entry() runs."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from premia.plans.catalogue import ORACLE, QUERIES


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == bool or not pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype(object).where(df[c].notna(), None).map(str)
        else:
            df[c] = df[c].astype(float)
    return df.sort_values(list(df.columns), ignore_index=True)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_oracle(spark, sf_dir, oracle, name):
    ours, theirs = plain(QUERIES[name](spark, sf_dir).toPandas()), plain(oracle.execute(ORACLE[name]).df())
    pd.testing.assert_frame_equal(ours, theirs, check_exact=True)


def test_entry(spark):
    found = {r.split: r for r in entry_module.entry(spark).collect()}
    assert (found["audit"].n, found["audit"].mae, found["audit"].wape) == (142, 403.3333, 0.047996)


def test_greedy_query(spark, sf_dir):
    rows = QUERIES["greedy_select"](spark, sf_dir).collect()
    assert len({r.quote_id for r in rows}) == 20 and sorted(r["rank"] for r in rows) == list(range(20))
