"""Every query that has SQL against DuckDB on the smallest tables."""

import importlib
import os

import pandas as pd
import pytest

entry = importlib.import_module("__spark_entry__")
CORE = importlib.import_module("boxloom.catalog")


def canon(df):
    def cell(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return "null"
        return repr(round(float(v), 9) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(CORE.SQL))
def test_against_sql(spark, data, name):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    got, want = CORE.QUERIES[name](spark, data).toPandas(), c.execute(CORE.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_entry(spark, data):
    assert set(CORE.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.queries()[CORE.FLAGSHIP](spark, data).count() > 0
