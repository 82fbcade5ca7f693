"""Queries of the subpackage that have SQL, against DuckDB on the same tables."""

from collections import Counter

import duckdb
import pytest

from weir.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    same = {"BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}
    assert {d[0]: same[str(d[1])] for d in want.description} == dict(got.dtypes)
    plain = lambda x: round(x, 6) if isinstance(x, float) else x
    assert Counter(tuple(map(plain, r)) for r in want.fetchall()) == Counter(tuple(map(plain, r)) for r in got.select(columns).collect())
