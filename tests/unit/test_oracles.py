"""Every registered query beside its oracle on the smallest tables, and what the contract promises."""

import decimal
import glob
import os

import duckdb
import pytest

from gradewell.plans import catalog

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, decimal.Decimal)):
        return str(int(v)) if v == int(v) else str(v)
    if isinstance(v, float):
        return f"{v:.6g}" if v else "0"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    found = catalog.queries()[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted(tuple(map(plain, r)) for r in found.select(*columns).collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert columns
        return
    expected = duck.sql(sql)
    assert sorted(expected.columns) == columns
    assert rows == sorted(tuple(map(plain, r)) for r in expected.select(*[f'"{c}"' for c in columns]).fetchall())
