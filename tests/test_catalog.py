"""Each registered query of the library itself against its SQL, on the smallest tables."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tessella.plans import catalog


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(rows):
    return sorted(tuple("" if v is None or v != v else f"{v + 0.0:.6f}" if isinstance(v, float) else str(v) for v in row) for row in rows)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SAME)))
def test_query(spark, sf_dir, tables, name):
    found = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    rows = [tuple(r[c] for c in columns) for r in found.collect()]
    if name not in catalog.SQL:
        assert rows
        return
    expected = tables.sql(catalog.SQL[name])
    assert sorted(expected.columns) == columns
    order = [expected.columns.index(c) for c in columns]
    assert plain(rows) == plain(tuple(r[k] for k in order) for r in expected.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
