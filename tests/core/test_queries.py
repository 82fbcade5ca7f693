"""Every query with SQL against DuckDB on the same tables."""

import math
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from weir.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, Decimal):
        return int(x) if x == x.to_integral_value() else float(x)
    return x


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def kind(t):
    t = str(t).upper()
    return {"DOUBLE PRECISION": "DOUBLE", "INT": "INTEGER", "STRING": "VARCHAR", "LONG": "BIGINT", "TIMESTAMP_NTZ": "TIMESTAMP"}.get(t, t)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    order = [columns.index(c) for c in got.columns]
    types = [kind(want.description[i][1]) for i in order]
    assert [kind(f.dataType.simpleString()) for f in got.schema] == types
    rows = Counter(tuple(plain(r[i]) for i in order) for r in want.fetchall())
    assert rows == Counter(tuple(map(plain, r)) for r in got.collect())


def test_queries_with_sql():
    assert set(QUERIES) == set(ORACLES)
