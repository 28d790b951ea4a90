"""SQLite files: round trips, ranges, filters, catalogs, commits."""

from __future__ import annotations

import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from querent.sources import sqlite


@pytest.fixture
def file(tmp_path):
    path = str(tmp_path / "a b.sqlite")
    con = sqlite3.connect(path)
    con.execute('CREATE TABLE "big one" (id INTEGER PRIMARY KEY, x REAL, name TEXT, odd, on_day DATE, raw BLOB)')
    con.executemany('INSERT INTO "big one" VALUES (?, ?, ?, ?, ?, ?)', [(i, i / 2, f"n{i % 7}", i if i % 2 else f"t{i}", "2020-01-02", b"\0\1") for i in range(1, 1001)])
    con.execute('INSERT INTO "big one" VALUES (5000, NULL, NULL, NULL, NULL, NULL)')
    con.execute('INSERT INTO "big one" VALUES (5001, \'text\', x\'ff\', 1.5, 7, \'text\')')
    con.execute("CREATE TABLE pairs (a INT DEFAULT 7, b TEXT NOT NULL, PRIMARY KEY (b, a)) WITHOUT ROWID")
    con.execute("INSERT INTO pairs VALUES (1, 'x'), (2, 'x')")
    con.execute('CREATE TABLE away (id INTEGER REFERENCES "big one", a INT, b TEXT, FOREIGN KEY (b, a) REFERENCES pairs)')
    con.execute('CREATE VIEW seen AS SELECT id FROM "big one" WHERE id <= 3')
    con.commit()
    con.close()
    return path


def test_rows_types_and_ranges(spark, file):
    t = sqlite.table(spark, file, "big one", rows=100)
    assert t.dtypes == [("id", "bigint"), ("x", "double"), ("name", "string"), ("odd", "string"), ("on_day", "string"), ("raw", "binary")]
    assert t.rdd.getNumPartitions() > 10 and t.count() == 1002
    rows = {r.id: tuple(r)[1:] for r in t.collect()}
    assert rows[3] == (1.5, "n3", "3", "2020-01-02", b"\0\1") and rows[4][2] == "t4"
    assert rows[5000] == (None,) * 5
    assert rows[5001] == (None, None, "1.5", "7", None)  # storage classes that aren't the column's
    assert sorted(r.id for r in sqlite.table(spark, file, "seen").collect()) == [1, 2, 3]
    assert sqlite.table(spark, file, "pairs").count() == 2
    assert sqlite.table(spark, file, "big one", ["name", "id"]).columns == ["name", "id"]


def test_filters_reach_the_statement(spark, file):
    t = sqlite.table(spark, file, "big one", rows=2000)
    whole = spark.createDataFrame(t.collect(), t.schema)
    for c in ("id > 990", "id <= 3 and x >= 1.0", "name = 'n3'", "name > 'n5'", "name in ('n1', 'n2')", "x is null", "x is not null", "odd = '3'", "odd is null", "id = 3 or x = 4.0", "not name = 'n1'", "x < 3"):
        assert sorted(map(repr, t.filter(c).collect())) == sorted(map(repr, whole.filter(c).collect())), c
    reader = sqlite.Sqlite({"path": file, "table": "big one"}).reader(t.schema)
    from pyspark.sql.datasource import EqualTo, In, IsNull

    asked = [EqualTo(("name",), "n3"), In(("id",), (1, 2)), IsNull(("x",)), EqualTo(("odd",), "3")]
    assert list(reader.pushFilters(asked)) == asked[2:]
    text, values = reader.statement(reader.partitions()[0])
    assert text.endswith("""WHERE "name" COLLATE BINARY = ? AND typeof("name") IN ('text') AND "id" COLLATE BINARY IN (?, ?) AND typeof("id") IN ('integer') AND rowid BETWEEN ? AND ?""")
    assert values[:3] == ["n3", 1, 2]
    plan = t.filter("id > 990").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan querent_sqlite" in plan and "Filter (" not in plan, plan  # the scan does it


def test_catalog(spark, file):
    columns, keys = sqlite.catalog(spark, file, "db")
    got = {(r.table, r.column): r for r in columns.collect()}
    assert (got["pairs", "a"].default, got["pairs", "a"].pk_ordinal, got["pairs", "b"].pk_ordinal, got["pairs", "b"].not_null) == ("7", 2, 1, True)
    assert got["big one", "id"].is_pk and not got["big one", "x"].is_pk and got["away", "a"].is_fk
    assert {tuple(r)[1:] for r in keys.collect()} == {("away", "id", "big one", "id"), ("away", "b", "pairs", "b"), ("away", "a", "pairs", "a")}


def test_commits(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(1000).select("id", (F.col("id") / 4).alias("x"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("é"), "id")).alias("s"))
    sqlite.write(df.repartition(4), path, "t")
    back = lambda: sorted(map(tuple, sqlite.table(spark, path, "t", rows=100).collect()))
    want = sorted(map(tuple, df.collect()))
    assert back() == want and len(sqlite.files(path)) == 4
    sqlite.write(df.filter("id < 10"), path, "t")
    assert len(back()) == 1010
    failing = df.select("id", "x", F.when(F.col("id") == 999, F.raise_error(F.lit("no"))).otherwise(F.col("s")).alias("s"))
    with pytest.raises(Exception):  # noqa: B017
        sqlite.write(failing.repartition(4), path, "t", mode="overwrite")
    assert len(back()) == 1010  # nothing of a write that failed counts
    sqlite.write(df, path, "t", mode="overwrite")
    assert back() == want
    sqlite.write(df.limit(0), path, "t", mode="overwrite")
    assert sqlite.files(path) == []
    assert not [f for f in os.listdir(path) if f.startswith("part-") and os.path.join(path, f) in sqlite.files(path)]


def test_other_stores_are_refused():
    with pytest.raises(ValueError, match="mounted"):
        sqlite.local("s3a://bucket/x")
    assert sqlite.local("file:///a/b") == sqlite.local("file:/a/b") == "/a/b"
