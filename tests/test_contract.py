"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from blockrank.plans import contract

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    kind = getattr(getattr(v, "dtype", None), "kind", "")
    return float(v) if kind == "f" else int(v) if kind in ("i", "u") else v


def rows(df, cols):
    return sorted(repr(tuple(plain(v) for v in r)) for r in df[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", contract.NAMES)
def test_query(spark, duck, name):
    got = contract.queries()[name](spark, DIR).toPandas()
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.execute(sql).df()
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    assert rows(got, cols) == rows(want, cols)
