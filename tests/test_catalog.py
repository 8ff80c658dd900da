"""Every catalogue query against its SQL on the smallest tables."""

import decimal
import math
from pathlib import Path

import duckdb
import pytest

from tidemark.plans import catalog

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="needs the driver's tables")


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return None if math.isnan(value) else round(float(value), 5)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, str(SF))
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in catalog.oracle_sql():
        found = duck.sql(catalog.oracle_sql()[name])
        at = [found.columns.index(c) for c in columns]
        assert sorted(found.columns) == columns
        assert rows == sorted((tuple(plain(r[k]) for k in at) for r in found.fetchall()), key=repr)


def test_entry(spark):
    assert catalog.entry(spark, str(SF)).count() > 0
