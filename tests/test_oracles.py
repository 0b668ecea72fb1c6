"""Every catalogue query against its SQL on the smallest tables; those without SQL must run and keep their schema."""

import math

import duckdb
import pytest

from reelframe.plans.adapters import TABLES
from reelframe.plans.catalogue import ORACLES, QUERIES

from .conftest import DATA


def normal(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool | str | int):
        return str(v)
    return f"{float(v):.6g}"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLES:
        assert df.columns
        return
    out = duck.execute(ORACLES[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(tuple(normal(r[i]) for i in order) for r in out.fetchall())
