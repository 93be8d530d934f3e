import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, sql, name):
    got = entry.queries()[name](spark, str(DATA))
    columns = sorted(got.columns)
    quoted = [f'"{c}"' for c in columns]
    want = sql.execute(f"select {', '.join(quoted)} from ({entry.oracle_sql()[name]})").fetchall()
    ours = [tuple(map(plain, r)) for r in got.select(columns).collect()]
    assert sorted(ours, key=repr) == sorted((tuple(map(plain, r)) for r in want), key=repr)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
