"""Every registered query with SQL gives the rows that DuckDB gives."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from millrace.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


def rows(df: pd.DataFrame) -> list:
    def said(v):
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return "~"
        return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    return sorted(tuple(said(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
