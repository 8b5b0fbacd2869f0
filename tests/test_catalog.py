"""Every query with SQL against DuckDB on the smallest tables; every other one runs."""

import os

import duckdb
import pandas as pd
import pytest

from tessella.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{DATA}/{f}')")
    return con


def rows(df: pd.DataFrame) -> list:
    def cell(v):
        if v is None or v != v:
            return ""
        if isinstance(v, pd.Timestamp):
            return v.tz_localize(None).isoformat() if v.tzinfo else v.isoformat()
        return repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    if name in catalog.SQL:
        assert rows(got) == rows(duck.execute(catalog.SQL[name]).df())


def test_upsert_has_keys_on_both_sides(spark, monkeypatch):
    sides, upsert = [], catalog.index.upsert
    monkeypatch.setattr(catalog.index, "upsert", lambda old, new, *a: sides.append((old, new)) or upsert(old, new, *a))
    rows = catalog.QUERIES["d1_upsert"](spark, DATA).count()
    old, new = ({r.point_id for r in x.collect()} for x in sides[0])
    assert old - new and old & new and new - old and rows == len(old | new)
