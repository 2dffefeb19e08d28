"""Every registered core query against its SQL, on the smallest driver tables."""

import decimal
import math
import os

import duckdb
import pytest

import tidemark.plans.documents  # noqa: F401
import tidemark.plans.items  # noqa: F401
import tidemark.plans.levels  # noqa: F401
import tidemark.plans.lookups  # noqa: F401
import tidemark.plans.queries  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float) and math.isnan(v):
        return None
    return f"{float(v):.8g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_like_sql(spark, db, name):
    df, want = QUERIES[name](spark, DATA), db.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).limit(5).collect()
