"""Queries of this subpackage against their SQL on a whole small folder."""

from pathlib import Path

import duckdb
import pytest

from tessera.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    db = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    want = db.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
