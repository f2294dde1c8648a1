"""Queries against their SQL on the small tables."""

import math

import duckdb
import pandas as pd
import pytest

from kinloom.plans import catalogue, formats

DATA = "/root/testdata/sf0.01"
TABLES = "customer documents embeddings events lineitem orders part supplier".split()
QUERIES = catalogue.queries() | formats.queries()
SQL = catalogue.oracle_sql() | formats.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def canon(df):
    def one(v):
        if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 8) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(([one(v.item() if hasattr(v, "item") else v) for v in r] for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want) and (len(got) or name == "fn_pairs")
