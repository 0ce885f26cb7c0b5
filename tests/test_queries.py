"""Every query that has SQL gives the rows that DuckDB gives, on the smallest tables."""

import decimal
from pathlib import Path

import duckdb
import pytest

from framewright import queries as q

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def plain(v):
    return int(v) if isinstance(v, decimal.Decimal) else v


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = q.QUERIES[name](spark, SF)
    want = duck.execute(q.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    pick = lambda row, names: tuple(plain(row[names.index(c)]) for c in sorted(names))
    assert sorted((pick(r, columns) for r in want.fetchall()), key=repr) == sorted((pick(tuple(r), got.columns) for r in got.collect()), key=repr)
