"""Every catalogued query against its SQL, on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from fluxweave.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    return "null" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.5f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    found = catalogue.QUERIES[name](spark, SF)
    rows = found.collect()
    if name not in catalogue.ORACLES:
        assert rows
        return
    want = duck.execute(catalogue.ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(found.columns) == cols
    expected = sorted(tuple(norm(v) for v in r) for r in want[cols].astype(object).values.tolist())
    assert sorted(tuple(norm(r[c]) for c in cols) for r in rows) == expected


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
