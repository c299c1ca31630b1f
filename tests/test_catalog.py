"""Every query with SQL against DuckDB, and the driver's entry points, on the smallest tables."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lakeloom.plans import catalog

SF = os.environ.get("LAKELOOM_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


def rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = (df[c].dt.tz_localize(None) if df[c].dt.tz is not None else df[c]).astype("datetime64[us]").astype(str)
    clean = lambda v: None if v is None or v != v else round(float(v), 9) if isinstance(v, float) else v
    return sorted((tuple(map(clean, r)) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, db, name):
    ours, theirs = catalog.QUERIES[name](spark, SF).toPandas(), db.sql(catalog.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_llm():
    for f in Path(catalog.__file__).parent.parent.rglob("*.py"):
        if "llm" not in f.parts:
            assert "llm" not in f.read_text(), f
