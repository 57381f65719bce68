"""Every registered query against its reference SQL on the smallest data set."""

import os

import duckdb
import pandas as pd
import pytest

from screenlake.plans.catalog import ORACLE, QUERIES
from screenlake.sources.fixtures import TABLES

SOURCE = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def folder():
    """The smallest data set; it has one repeated line item, so box ids repeat too."""
    return SOURCE


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canon(df: pd.DataFrame) -> list[tuple]:
    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "NULL"
        return repr(float(v)) if isinstance(v, float) else str(v)

    cols = sorted(df.columns)
    return sorted(tuple(text(v) for v in row) for row in df[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, duck, folder, name):
    got = QUERIES[name](spark, folder).toPandas()
    want = duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
