"""Every registered query against its SQL in DuckDB at the smallest size, or its rows if there is no SQL."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from panelspark.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 4) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def key(rows, order):
    return sorted((tuple(canonical(row[i]) for i in order) for row in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return con


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, SF)
    rows = found.collect()
    if name not in registry.ORACLES:
        assert rows
        return
    want = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(found.columns)
    order = sorted(found.columns)
    left = key(rows, [found.columns.index(c) for c in order])
    right = key(want.fetchall(), [columns.index(c) for c in order])
    assert len(left) == len(right)
    for a, b in zip(left, right, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-4)), (a, b)
