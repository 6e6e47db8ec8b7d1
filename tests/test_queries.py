"""Every registered query with SQL gives what DuckDB gives on sf0.001."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def con(sf_dir):
    out = duckdb.connect()
    out.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        out.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return out


def normal(df: pd.DataFrame) -> list:
    def cell(v):
        if v is None or v != v:
            return None
        if hasattr(v, "item"):
            v = v.item()
        return f"{v:.8g}" if isinstance(v, float) else v

    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, con, name):
    got, want = entry.queries()[name](spark, sf_dir).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
