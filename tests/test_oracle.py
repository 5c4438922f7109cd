"""Every query that SQL can express gives what its SQL gives."""

from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from tessera.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    made = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        made.execute(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    return made


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda v: float(v) if isinstance(v, Decimal) else v
    return sorted([tuple(fix(r[i]) for i in order) for r in found], key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in SQL:
        assert got
        return
    rel = db.sql(SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    assert got == rows(rel.columns, rel.fetchall())
