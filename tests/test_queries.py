"""Every query against its SQL twin on the smallest tables."""

import decimal
import math
import os
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
if not DATA.exists():
    pytest.skip("no test tables", allow_module_level=True)

from sieveworks.plans import catalog  # noqa: E402


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


#: Queries that SQL can't express, and where their operators are tested against brute force or fixtures.
OWN_TESTS = {"p3_found": "test_packed.py", "p3_sizes": "test_packed.py", "p5_table": "test_drift.py"}


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, views, name):
    df = catalog.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in catalog.sql():
        assert name in OWN_TESTS and got, f"{name} has neither a twin nor tests of its own"
        return
    sql = views.sql(catalog.sql()[name])
    assert sorted(sql.columns) == cols
    at = [sql.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in sql.fetchall()), key=repr)


def test_found_rows_are_distinct(spark):
    for name, q in catalog.queries().items():
        if name.endswith("_found"):
            df = q(spark, str(DATA))
            rows = df.collect()
            assert len(rows) == len(set(rows)), name
