"""Every registered query that has SQL gives the SQL's rows."""

import importlib
import os

import duckdb
import pandas as pd
import pytest

entry = importlib.import_module("__spark_entry__")
from ledgerline import plans  # noqa: E402


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return "null"
        return repr(round(float(v), 6)) if isinstance(v, float | int) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "fiu" else str(v)

    return sorted(tuple(map(one, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    got, want = plans.queries()[name](spark, sf_dir).toPandas(), duck.sql(plans.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert plans.queries()[name](spark, sf_dir).count() > 0


def test_entry_and_registry(spark):
    assert entry.entry(spark).columns == ["doc_id", "score", "rank", "terms"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
