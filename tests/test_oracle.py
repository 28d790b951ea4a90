"""Every query of the engine that SQL can express against DuckDB on the same tables."""

from __future__ import annotations

import duckdb
import pytest

from querent import queries
from querent.sources.catalog import KEYS


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for n in KEYS:
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{sf}/{n}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(spark, sf, con, name):
    got = queries.QUERIES[name](spark, sf)
    rows = sorted(repr(tuple(r)) for r in got.select(*sorted(got.columns)).collect())
    want = con.execute(queries.ORACLE[name])
    columns = [d[0] for d in want.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    assert sorted(columns) == sorted(got.columns)
    assert rows == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 11
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
