"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from glyphframe.plans import registry
from glyphframe.plans.fixtures import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def value(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    rows = [tuple(value(r[k]) for k in order) for r in rows]
    return sorted(columns), sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v) for v in r))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    got = table(df.columns, df.collect())
    cursor = db.execute(registry.ORACLE_SQL[name])
    want = table([d[0] for d in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
